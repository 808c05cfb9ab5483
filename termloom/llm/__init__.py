"""Operators that prepare training corpora: scoring, de-duplication, filtering, mixing, encoding, search."""
