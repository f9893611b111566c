"""Operators over text corpora: duplicates, quality, contamination, mixing, sharding, archives, language models."""
