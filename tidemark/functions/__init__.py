"""Scalar functions that Spark has no name for."""
