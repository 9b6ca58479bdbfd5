"""Streaming of the analytics package."""
