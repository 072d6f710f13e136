"""Operators that are not part of the query language."""
