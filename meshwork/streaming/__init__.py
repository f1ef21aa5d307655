"""streaming of the coverage engine."""
