"""Operators for training-data corpora: deduplication, filtering, search, mixing, tokenising.

Nothing else in the library imports this subpackage.
"""
