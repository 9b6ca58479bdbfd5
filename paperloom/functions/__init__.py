"""Functions of the analytics package."""
