"""Sources of the mapping engine."""
