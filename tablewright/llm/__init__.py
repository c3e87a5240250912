"""Operators for training data: deduplication, filtering, scoring, mixing, encoding."""
