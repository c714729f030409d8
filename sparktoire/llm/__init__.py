"""Operators for training-data corpora: quality, deduplication, scoring and tokenisation of documents."""
