"""Functions of the mapping engine."""
