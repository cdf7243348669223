"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it. Every operator takes and returns
DataFrames; the thin ``opN_*`` queries live in :mod:`cliploom.llm.registry`.
"""
