"""Operators for large text corpora: index, filter, deduplicate, mix, score and encode documents."""
