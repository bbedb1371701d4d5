"""Relational operators of the semantic filter."""
