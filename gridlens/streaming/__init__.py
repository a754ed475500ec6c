"""Structured Streaming forms of batch programs."""
