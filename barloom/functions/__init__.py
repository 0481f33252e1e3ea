"""Functions of the market engine."""
