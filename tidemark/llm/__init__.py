"""Operators for preparing training text: deduplication, filtering, tokenising and extraction."""
