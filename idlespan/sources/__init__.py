"""Reading and writing tables, patterns, mappings and models."""
