"""Column functions and pattern helpers."""
