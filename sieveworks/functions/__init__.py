"""Column functions and pure helpers."""
