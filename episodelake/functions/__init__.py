"""Column functions and helpers for Python workers."""
