"""Operators for training-data corpora: filtering, deduplication, search, sharding and tokenisation.

Nothing else in the library imports this subpackage.
"""
