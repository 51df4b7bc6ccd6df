"""Runnable queries: inputs derived from the driver's tables, operators on top, and their SQL twins."""
