"""Structured Streaming jobs over links, logs and events."""
