"""Relational operators that Spark has no name for."""
