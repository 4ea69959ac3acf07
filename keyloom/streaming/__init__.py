"""Structured Streaming twins of the batch operators and stateful processors."""
