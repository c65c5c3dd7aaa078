"""Registered queries, each with the SQL that must give the same rows."""
from rotapanel.catalog.registry import load_all

__all__ = ["load_all"]
