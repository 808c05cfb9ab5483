"""Operators of the mapping engine."""
