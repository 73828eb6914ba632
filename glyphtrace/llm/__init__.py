"""Operators for preparing training text: scoring, near duplicates, mixing, tokens, media columns."""
