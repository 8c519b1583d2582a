"""Structured Streaming forms of the incremental state."""
