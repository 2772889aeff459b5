"""Incrementally maintained summaries on Structured Streaming."""
