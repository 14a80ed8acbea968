"""sources of the memory engine."""
