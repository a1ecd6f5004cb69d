"""Operators for training data: deduplication, language, packing, extraction, shards, tokens and quality."""
