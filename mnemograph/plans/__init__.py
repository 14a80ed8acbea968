"""plans of the memory engine."""
