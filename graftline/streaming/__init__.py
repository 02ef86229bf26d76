"""Structured Streaming over the same tables."""
