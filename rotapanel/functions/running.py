"""Running sums and exact quantiles without a single sorted partition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.session import join_small, stored


def running_sums(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``cum_<value>``: the sum up to and including each row, in ``order``.

    Rows are range-partitioned, each range is summed on its own and shifted by
    the sums of the ranges before it. ``by`` columns must not be NULL. The
    result is only meaningful with one row per (by, order).
    """
    by = by or []
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, order]])
    sliced = stored(ranged.withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy("_slice", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_slice", *by, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values]
    )
    inner = Window.partitionBy("_slice", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_small(sliced, shifts, ["_slice", *by])
    return out.withColumns(
        {f"cum_{v}": F.sum(v).over(inner) + F.col(f"_before_{v}") for v in values}
    ).drop("_slice", *[f"_before_{v}" for v in values])


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, plus the row count and mean.

    Works on the frequency of each distinct value, so equal values are
    combined before any shuffle and no group sits in one task.
    """
    by = by or []
    freq = stored(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))
    ranked = running_sums(freq, value, ["n"], by)
    sizes = freq.groupBy(*by).agg(F.sum("n").alias("_all"), F.sum(F.col("n") * F.col(value)).alias("_total"))
    if by:
        ranked = join_small(ranked, sizes, by)
    else:
        ranked = ranked.join(F.broadcast(sizes), F.lit(True))  # one row
    picks: list[Column] = []
    for name, p in probabilities.items():
        at = (F.col("_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("cum_n") > rank, F.col(value))).alias(f"{name}_{side}"))
    found = ranked.groupBy(*by).agg(
        *picks, F.max("_all").alias("n"), (F.max("_total") / F.max("_all")).alias("mean")
    )
    exact = []
    for name, p in probabilities.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        exact.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return found.select(*by, "n", *exact, "mean")
