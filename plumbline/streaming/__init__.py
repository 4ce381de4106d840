"""Structured Streaming forms of the mergeable metrics."""
