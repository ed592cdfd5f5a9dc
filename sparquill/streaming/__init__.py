"""Structured Streaming: the stateful semantic cache, and windows over its traffic."""
