"""Relational operators that Spark has no syntax for, composed of DataFrame operations."""
