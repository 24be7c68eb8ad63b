"""Structured Streaming: windowed aggregates, sessions, change feeds and batch-wise training."""
