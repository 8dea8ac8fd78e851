"""Structured Streaming: the bronze consumer and windowed aggregates."""
