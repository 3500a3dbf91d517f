"""Structured Streaming jobs over progress events and new assets."""
