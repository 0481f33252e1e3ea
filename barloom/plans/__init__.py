"""Plans of the market engine."""
