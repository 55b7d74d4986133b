"""Operators of a training-data pipeline: scoring, packing, archives, deduplication, filters, tokenizers."""
