"""Column-level building blocks; all stay inside Spark's expression engine."""
