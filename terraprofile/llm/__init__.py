"""Operators of a training-data pipeline: filters, deduplication, extraction, tokens, packing, archives."""
