"""Operators for large text corpora: duplicates, quality, language, web records, shards, mixing and tokens."""
