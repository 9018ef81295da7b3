"""Check queries: the same results written independently as plain SQL over the given tables."""
