"""Operators for preparing training data: search, scoring, packing, quality, duplicates, mixing, language, tokens."""
