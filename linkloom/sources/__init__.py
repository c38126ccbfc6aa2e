"""sources of the link engine."""
