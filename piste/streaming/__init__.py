"""Structured Streaming versions of the incremental fact loads."""
