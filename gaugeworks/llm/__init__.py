"""Operators for preparing training data: near-duplicates, personal data, tokens, quality, search, pages."""
