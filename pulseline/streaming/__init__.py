"""Structured Streaming twins of the batch operators, replay and sinks."""
