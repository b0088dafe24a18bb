"""Column functions whose names or conventions differ from Spark's own."""
