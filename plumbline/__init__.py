"""Data-quality analytics written as plain Spark DataFrame jobs."""
