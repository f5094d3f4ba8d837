"""Column helpers that Spark's own functions don't have."""
