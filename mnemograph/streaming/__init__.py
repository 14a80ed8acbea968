"""streaming of the memory engine."""
