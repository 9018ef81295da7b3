"""Operators for preparing training text: encoding, deduplication, quality, privacy, packing, search."""
