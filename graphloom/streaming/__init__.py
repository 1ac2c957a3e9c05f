"""Structured Streaming forms of what a store does over time."""
