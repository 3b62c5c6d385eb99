"""Column expressions over names, paths and headers."""
