"""Operators of the analytics package."""
