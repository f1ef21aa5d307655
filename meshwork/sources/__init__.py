"""sources of the coverage engine."""
