"""Operators that are compositions of Spark's own."""
