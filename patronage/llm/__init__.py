"""Operators for preparing training text: deduplication, extraction, filtering, scoring, mixing, sharding."""
