"""Property-sales analytics as Spark DataFrame plans."""
