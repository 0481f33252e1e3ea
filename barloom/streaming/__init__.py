"""Streaming of the market engine."""
