"""End-to-end plans, each one lazy chain of operators."""
