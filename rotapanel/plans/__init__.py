"""End-to-end chains composed from the operators."""
