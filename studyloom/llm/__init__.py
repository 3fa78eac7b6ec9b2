"""Operators of a training-data pipeline: deduplication, scoring, tokenizing, mixing, search, sharding."""
