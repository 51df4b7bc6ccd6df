"""Readers of landed raw files: fixed schemas, checked headers, loud failure."""
