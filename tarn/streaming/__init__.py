"""Structured Streaming forms of time-based operators."""
