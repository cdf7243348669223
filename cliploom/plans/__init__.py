"""Operators that are relational plans rather than expressions on a clip."""
