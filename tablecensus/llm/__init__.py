"""Operators of a training-data pipeline: cleaning, deduplication, scoring and mixing of documents."""
