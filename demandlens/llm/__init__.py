"""Operators for training-data pipelines: deduplication, quality, packing, sharding, tokens, archives, language models."""
