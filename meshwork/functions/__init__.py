"""functions of the coverage engine."""
