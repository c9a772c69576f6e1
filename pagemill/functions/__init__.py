"""Column functions: built from Spark SQL expressions, no Python evaluation."""
