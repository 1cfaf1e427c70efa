"""Operators of a training-data pipeline: mixing, formatting, tokenizing, deduplication, filters and search."""
