"""Plans of the mapping engine."""
