"""Structured Streaming jobs over the same functions."""
