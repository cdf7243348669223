"""Transforms over records, and what composes them."""
