"""plans of the coverage engine."""
