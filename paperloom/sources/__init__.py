"""Sources of the analytics package."""
