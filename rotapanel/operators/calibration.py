"""Linear calibration of weights to control totals."""
from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations_with_replacement as pairs_of

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotapanel.functions.running import quantiles
from rotapanel.operators.weights import or_fail
from rotapanel.session import join_groups, join_small

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def poststratify(
    df: DataFrame,
    weight: str,
    controls: DataFrame,
    total: str,
    by: list[str],
    within: list[str] | None = None,
    name: str = "w_cal",
    sums_from: DataFrame | None = None,
    unmatched: str = "fail",
) -> DataFrame:
    """Calibrate to one total per cell of ``by``: weights times N / N-hat.

    A row whose cell has no control ends the job; with unmatched="keep" it stays, with a NULL weight.

    ``within`` repeats the calibration per period against the same totals, as
    a longer grouping key. A cell without sample cannot meet its total and
    is reported by :func:`uncovered_controls`. ``sums_from`` names a cheaper
    table with the same weights per cell, when ``df`` is costly to build.
    """
    keys = [*(within or []), *by]
    sums = (df if sums_from is None else sums_from).groupBy(*keys).agg(F.sum(weight).alias("_have"))
    factors = sums.join(controls.select(*by, F.col(total).alias("_want")), by).select(
        *keys, F.try_divide(F.col("_want"), F.col("_have")).alias("g")
    )
    g = or_fail(F.col("g"), "a cell of the sample has no control total", unmatched)
    return join_small(df, factors, keys, "left").withColumn(name, F.col(weight) * g).drop("g")


def integrative(
    homes: DataFrame,
    weight: str,
    size: str,
    controls: DataFrame,
    total: str,
    by: list[str],
    name: str = "w_cal",
    unmatched: str = "fail",
) -> DataFrame:
    """Calibrate household weights to person totals, with household size as variable.

    g = 1 + n (N - sum d n) / sum d n^2, per cell of ``by``. Rows without a control as in :func:`poststratify`.
    """
    d, n = F.col(weight), F.col(size)
    sums = homes.groupBy(*by).agg(F.sum(d * n).alias("_have"), F.sum(d * n * n).alias("_square"))
    slopes = sums.join(controls.select(*by, F.col(total).alias("_want")), by).select(
        *by, ((F.col("_want") - F.col("_have")) / F.col("_square")).alias("_lambda")
    )
    slope = or_fail(F.col("_lambda"), "a cell of the sample has no control total", unmatched)
    return join_small(homes, slopes, by, "left").withColumn(name, d * (1 + n * slope)).drop("_lambda")


def solved(gram: np.ndarray, right: np.ndarray, labels: list[str]) -> np.ndarray:
    """Least-squares solution of the calibration system; it may have redundant terms, but none that can't be met."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    out = np.linalg.lstsq(gram / np.outer(scale, scale), (right.T / scale).T, rcond=1e-11)[0]
    out = (out.T / scale).T
    miss = np.abs(gram @ out - right).reshape(len(labels), -1).max(1)
    size = np.maximum(np.abs(right).reshape(len(labels), -1).max(1), np.diag(gram))
    bad = [t for t, m, s in zip(labels, miss, size) if m > 1e-6 * max(s, 1e-300)]
    if bad:
        raise ValueError(f"the totals of {', '.join(bad)} can't be met: terms without sample, or that contradict each other")
    return out


def calibrate(
    df: DataFrame,
    weight: str,
    terms: dict[str, Column],
    totals: dict[str, float],
    name: str = "w_cal",
    within: list[str] | None = None,
) -> DataFrame:
    """Linear calibration on any 0/1 or numeric terms.

    One pass sums d z z' and d z; the system has as many equations as terms. ``within`` repeats the calibration per period against
    the same totals: still one pass, and each period's small system is solved where its sums lie; the multipliers are joined
    to the rows by size. Use :func:`poststratify` when the terms are disjoint cells.
    """
    labels, keys = list(terms), within or []
    z = [terms[t].cast("double") for t in labels]
    d, p = F.col(weight), len(terms)
    upper, want = np.triu_indices(p), np.array([totals[t] for t in labels])
    zero = F.lit(0.0)
    sums = df.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.sum(d * x), zero) for x in z]).alias("_t"),
        F.array(*[F.coalesce(F.sum(d * z[j] * z[k]), zero) for j, k in pairs_of(range(p), 2)]).alias("_g"),
    )

    def multipliers(t: list[float], g: list[float]) -> list[float]:
        gram = np.zeros((p, p))
        gram[upper] = g
        return [float(x) for x in solved(gram + np.triu(gram, 1).T, want - np.array(t), labels)]

    if not keys:
        found = [F.lit(x) for x in multipliers(*sums.first())]
    else:
        schema = T.StructType([*(sums.schema[c] for c in keys), T.StructField("_m", T.ArrayType(T.DoubleType()))])

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [multipliers(t, g) for t, g in zip(batch["_t"].to_pylist(), batch["_g"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(each, pa.list_(pa.float64()))], [*keys, "_m"])

        df = join_groups(df, sums.mapInArrow(solve, schema), keys, "left")
        found = [F.col("_m")[j] for j in range(p)]
    g = F.lit(1.0)
    for j in range(p):
        g = g + z[j] * found[j]
    return df.withColumn(name, d * g).drop("_m")


def calibration_gaps(
    df: DataFrame, weight: str, controls: DataFrame, total: str, by: list[str], size: str | None = None
) -> DataFrame:
    """Estimated total, control and absolute difference per cell."""
    x = F.col(weight) if size is None else F.col(weight) * F.col(size)
    ours = df.groupBy(*by).agg(F.sum(x).alias("total"))
    return ours.join(controls.select(*by, F.col(total).alias("control")), by).withColumn(
        "dif", F.abs(F.col("total") - F.col("control"))
    )


def unmatched_cells(df: DataFrame, controls: DataFrame, by: list[str]) -> DataFrame:
    """Cells on one side only: ``side`` is "sample" or "control", with the rows they have there."""
    both = df.groupBy(*by).agg(F.count("*").alias("n_sample")).join(
        controls.groupBy(*by).agg(F.count("*").alias("n_control")), by, "full"
    )
    side = F.when(F.col("n_control").isNull(), "sample").when(F.col("n_sample").isNull(), "control")
    return both.select(*by, side.alias("side"), F.coalesce("n_sample", "n_control").alias("n")).where("side IS NOT NULL")


def uncovered_controls(df: DataFrame, controls: DataFrame, by: list[str]) -> DataFrame:
    """Controls whose cell has no row, which calibration cannot meet."""
    return controls.join(df.select(*by).distinct(), by, "left_anti")


def pick_controls(monthly: DataFrame, how: str, period: str = "mes", term: str = "term") -> DataFrame:
    """Controls of a longer period from monthly ones: its middle month or the mean."""
    if how == "mean":
        return monthly.groupBy(term).agg(F.avg("total").alias("total"))
    if how != "middle":
        raise ValueError("how is 'middle' or 'mean'")
    span = monthly.agg(F.min(period).alias("lo"), F.max(period).alias("hi")).first()
    return monthly.where(F.col(period) == (span.lo + span.hi) // 2).select(term, "total")


def weight_summary(df: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, quartiles, mean and maximum of the weights."""
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(df, weight, points, by).drop("n")


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    width = (span.hi - span.lo) / bins
    if width == 0:
        index = F.lit(1).cast("long")
    else:
        index = F.least(F.floor((F.col(value) - span.lo) / width) + 1, F.lit(bins).cast("long"))
    return df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
