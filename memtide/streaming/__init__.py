"""Structured Streaming: the store queue, the command tracker, online transitions, and the event router."""
