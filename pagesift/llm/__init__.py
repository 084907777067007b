"""Operators for large-scale training data: tokens, shards, duplicates, quality, language, archives."""
