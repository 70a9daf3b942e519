"""Column expressions: every function here returns native Spark columns."""
