"""Operators for training corpora: filters, deduplication, tokenisation, search.

Nothing else in the library imports this package.
"""
