"""Operators that prepare training data: classification, deduplication, mixing, tokens, archives and scans."""
