"""Plans of the analytics package."""
