"""streaming of the link engine."""
