"""Scalar rules as Spark column expressions."""
