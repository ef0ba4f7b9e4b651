"""Operators for large training-data pipelines: near-duplicates, filters, mixing, tokens, vector search."""
