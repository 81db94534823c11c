"""Operators for building training corpora: dedup, filters, mixing, tokens, shards."""
