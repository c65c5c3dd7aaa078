"""Long and wide forms, dummies and completed grids."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_wide(
    df: DataFrame,
    keys: list[str],
    names: str,
    value: Column,
    levels: list,
    fill=None,
    prefix: str = "",
) -> DataFrame:
    """One column per level of ``names``; absent cells take ``fill``."""
    wide = df.groupBy(*keys).pivot(names, levels).agg(value)
    if fill is not None:
        wide = wide.fillna(fill, subset=[str(x) for x in levels])
    return wide.withColumnsRenamed({str(x): f"{prefix}{x}" for x in levels}) if prefix else wide


def with_total(df: DataFrame, parts: list[str], name: str = "Total") -> DataFrame:
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(p) for p in parts]))


def complete_grid(df: DataFrame, levels: dict[str, list], fill: dict[str, object]) -> DataFrame:
    """Add the missing combinations of the listed levels; other rows stay.

    The grid has as many rows as the product of the level lists, which are
    stated in the program.
    """
    spark = df.sparkSession
    combos = reduce(
        lambda acc, vals: [(*a, v) for a in acc for v in vals], levels.values(), [()]
    )
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in levels)
    grid = spark.createDataFrame(combos, schema)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"d.{c}")) for c in levels]
    rest = [c for c in df.columns if c not in levels]
    both = grid.alias("g").join(df.alias("d"), reduce(lambda a, b: a & b, same), "full_outer")
    return both.select(
        *[F.coalesce(F.col(f"g.{c}"), F.col(f"d.{c}")).alias(c) for c in levels],
        *[F.coalesce(F.col(f"d.{c}"), F.lit(fill[c])).alias(c) if c in fill else F.col(f"d.{c}") for c in rest],
    )


def dummies_long(df: DataFrame, keys: list[str], category: str, size: Column | None = None) -> DataFrame:
    """(keys, term, x): the only non-zero dummy of each row."""
    return df.select(*keys, F.col(category).alias("term"), (F.lit(1.0) if size is None else size).alias("x"))


def dummies_wide(df: DataFrame, category: str, levels: list, prefix: str) -> DataFrame:
    """0/1 columns ``prefix + level``, replacing nothing."""
    return df.select(
        "*", *[F.when(F.col(category) == x, 1).otherwise(0).alias(f"{prefix}{x}") for x in levels]
    )


def rename_matching(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Regex rename over all column names."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def scale_matching(df: DataFrame, pattern: str, factor: Column) -> DataFrame:
    """Multiply every column whose name matches by ``factor``."""
    rx = re.compile(pattern)
    return df.select(
        *[(F.col(c) * factor).alias(c) if rx.search(c) else F.col(c) for c in df.columns]
    )
