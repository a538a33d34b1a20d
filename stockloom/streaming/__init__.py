"""Structured Streaming jobs over the transaction stream."""
