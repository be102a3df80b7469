"""Structured Streaming: the tag log as a stream."""
