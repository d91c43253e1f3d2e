"""Structured Streaming twins of the batch operators."""
