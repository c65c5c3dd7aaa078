"""Where the query modules put their entries."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}

MODULES = [
    "sources",
    "columns",
    "joins",
    "aggregates",
    "reshaping",
    "weighting",
    "calibrating",
    "estimating",
    "panels",
    "transitions",
]


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name`` with its SQL, if SQL can express it."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return run

    return add


def load_all() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"rotapanel.catalog.{module}")
    return dict(QUERIES)
