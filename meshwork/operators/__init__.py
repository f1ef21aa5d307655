"""operators of the coverage engine."""
