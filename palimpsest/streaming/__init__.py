"""Incremental index building with Structured Streaming."""
