"""Operators of a training-data pipeline: cleaning, deduplication, scoring and tokens of documents."""
