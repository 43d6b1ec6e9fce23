"""Column expressions. Each takes and returns Columns and stays inside Spark's own functions."""
