"""Structured Streaming forms of the round monitors."""
