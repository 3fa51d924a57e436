"""Structured Streaming forms of the cleaning operators."""
