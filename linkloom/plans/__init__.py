"""plans of the link engine."""
