"""Structured Streaming jobs over raw JSON events."""
