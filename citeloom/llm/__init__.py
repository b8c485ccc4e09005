"""Operators for preparing training data: mixing, tokenizing, filtering, deduplicating, rendering and retrieval."""
