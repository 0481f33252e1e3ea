"""Operators of the market engine."""
