"""Reading and writing survey tables."""
