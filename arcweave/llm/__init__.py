"""Operators for the preparation of training data. Nothing outside imports
this package; it may be removed whole."""
