"""Streaming of the mapping engine."""
