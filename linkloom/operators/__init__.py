"""operators of the link engine."""
