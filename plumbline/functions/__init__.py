"""Column and window functions that Spark lacks."""
