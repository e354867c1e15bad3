"""Structured Streaming: hazards that arrive as a stream."""
