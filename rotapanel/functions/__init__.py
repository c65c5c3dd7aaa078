"""Column and reshaping helpers."""
