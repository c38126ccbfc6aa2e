"""functions of the link engine."""
