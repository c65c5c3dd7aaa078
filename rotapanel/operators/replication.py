"""Replicate totals per sampling unit: jackknife, bootstrap and half-samples, with calibration repeated in each.

Units are arrays of sums; a replicate is another array, linear in them. Where weights are calibrated, the arrays hold the sums that
the calibration needs (of terms, of their products, of products with the measures), and each replicate's
small system is solved where its row lies.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import replace
from itertools import combinations_with_replacement as pairs_of

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.functions.recode import hash_number
from rotapanel.functions.running import running_sums
from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.session import join_small, settle

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOW_BITS = 10  # replicates (and strata) of a block of the half-sample transform, as bits


def unit_vectors(design: SurveyDesign, measures: dict[str, Column]) -> DataFrame:
    """One row per unit with an array of its weighted sums, in the order given.

    The table has as many rows as the design has units and is written once.
    """
    w, inside = F.col(design.weight), design.inside
    sums = [
        F.sum(F.when(inside, F.coalesce(w * e.cast("double"), F.lit(0.0))).otherwise(0.0)) for e in measures.values()
    ]
    rows = design.df.groupBy(F.col(design.strata).alias("h"), F.col(design.psu).alias("i")).agg(
        F.array(*sums).alias("v")
    )
    return settle(rows)


def _sum_vectors(column: str, size: int, times: Column | None = None) -> Column:
    parts = [F.col(column)[j] if times is None else F.col(column)[j] * times for j in range(size)]
    return F.array(*[F.sum(p) for p in parts])


def full_totals(units: DataFrame, size: int) -> DataFrame:
    return units.agg(_sum_vectors("v", size).alias("total"))


def jackknife_totals(design: SurveyDesign, units: DataFrame, size: int) -> DataFrame:
    """Totals with one unit left out and its stratum scaled up, one row per unit.

    ``factor`` is the weight of the squared deviation in the variance.
    """
    strata = units.groupBy("h").agg(F.count(F.lit(1)).alias("n"), _sum_vectors("v", size).alias("s"))
    whole = full_totals(units, size)
    joined = join_small(units, strata, ["h"]).join(F.broadcast(whole), F.lit(True))  # one row
    n = F.col("n")

    def left_out(j: int) -> Column:
        kept = (F.col("s")[j] - F.col("v")[j]) * (n / (n - 1))
        return F.col("total")[j] - F.col("s")[j] + kept

    alone = design.lonely_factor(n, F.lit(1.0)) == 0
    rows = F.when(alone, F.col("total")).otherwise(F.array(*[left_out(j) for j in range(size)]))
    return joined.select(
        F.concat_ws(":", "h", F.col("i").cast("string")).alias("rep"),
        rows.alias("cells"),
        ((n - 1) / n).alias("factor"),
    )


def numbered_units(units: DataFrame) -> DataFrame:
    """Number the units inside their stratum; a unit row holds a short array."""
    return units.withColumns(
        {
            "k": F.row_number().over(Window.partitionBy("h").orderBy("i")),
            "n": F.count(F.lit(1)).over(Window.partitionBy("h")),
        }
    )


def bootstrap_totals(units: DataFrame, size: int, replicates: int = 200, seed: int = 15) -> DataFrame:
    """Totals of rescaled bootstrap samples of n - 1 units per stratum.

    Draws are hashes of (stratum, replicate, draw, seed), so a retried task
    draws the same units.
    """
    numbered = numbered_units(units)
    sizes = numbered.select("h", "n").distinct()
    draws = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))))
        .withColumn("k", (hash_number(["h", "rep", "draw"], seed) % F.col("n") + 1).cast("int"))
        .groupBy("h", "rep", "k", "n")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    scale = F.when(F.col("n") > 1, F.col("n") / (F.col("n") - 1)).otherwise(F.lit(1.0)) * F.col("times")
    picked = draws.join(numbered.select("h", "k", "v"), ["h", "k"])
    return picked.groupBy(F.col("rep").cast("string").alias("rep")).agg(
        _sum_vectors("v", size, scale).alias("cells")
    ).withColumn("factor", F.lit(1.0 / replicates))


def signed_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows h with the signs (-1)^bits(r & h), for every r: the Walsh-Hadamard transform."""
    x, step = x.copy(), 1
    while step < len(x):
        pairs = x.reshape(-1, 2, step, x.shape[1])
        x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], 1).reshape(x.shape)
        step *= 2
    return x


def half_sample_totals(units: DataFrame, size: int) -> DataFrame:
    """Balanced half-samples: each stratum's units form two halves.

    Replicate r keeps, scaled up to the stratum, the half whose sign is (-1)^bits(r & h) for
    stratum number h; the number of replicates is the power of two above the number of strata. The
    totals are the strata's means of both halves plus the signed sums of their differences: a product with a
    Hadamard matrix, made in blocks of strata and then in blocks of replicates.
    """
    strata = units.select("h").distinct().withColumn("one", F.lit(1))
    numbered = settle(running_sums(strata, "h", ["one"]).select("h", F.col("cum_one").alias("hn")))
    count = numbered.count()
    bits = max(1, count.bit_length())
    low = min(bits, LOW_BITS)
    halves = numbered_units(units).withColumn("half", F.col("k") % 2)
    # A half of k of n units stands for the whole stratum; a single unit is in both.
    in_half = F.floor((F.col("n") + F.col("half")) / 2)
    halves = halves.withColumn("scale", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("n") / in_half))

    def half(sign: int) -> Column:
        own = F.when((F.col("half") == sign) | (F.col("n") == 1), F.col("scale")).otherwise(0.0)
        return _sum_vectors("v", size, own)

    both = halves.groupBy("h").agg(half(0).alias("a"), half(1).alias("b"))
    both = join_small(both, numbered, ["h"]).select(
        "hn", F.zip_with("a", "b", lambda a, b: (a + b) / 2).alias("mean"), F.zip_with("a", "b", lambda a, b: (a - b) / 2).alias("v")
    )
    both = settle(both)
    mean = both.agg(_sum_vectors("mean", size).alias("mean"))

    def block(key: str, place: str, out: str, length: int):
        """Signed sums within a block: rows ``place`` of it become rows ``out``."""

        def run(table: pa.Table) -> pa.Table:
            x = np.zeros((length, size))
            x[table[place].to_numpy()] = np.array(table["v"].to_pylist()).reshape(-1, size)
            found = signed_sums(x)
            own = table[key][0].as_py()
            return pa.table({key: pa.array([own] * length, pa.int64()), out: pa.array(range(length), pa.int64()), "v": pa.array(found.tolist())})

        return run

    split = both.select(F.expr(f"shiftright(hn, {low})").cast("long").alias("high"), F.expr(f"hn % {1 << low}").cast("long").alias("low"), "v")
    first = split.groupBy("high").applyInArrow(block("high", "low", "r_low", 1 << low), "high long, r_low long, v array<double>")
    second = first.groupBy("r_low").applyInArrow(
        block("r_low", "high", "r_high", 1 << (bits - low)), "r_low long, r_high long, v array<double>"
    )
    rows = second.join(F.broadcast(mean), F.lit(True))  # one row
    return rows.select(
        (F.col("r_high") * (1 << low) + F.col("r_low")).cast("string").alias("rep"),
        F.zip_with("v", "mean", lambda v, m: v + m).alias("cells"), F.lit(1.0 / (1 << bits)).alias("factor"),
    )


def _terms(design: SurveyDesign) -> dict[str, Column]:
    cal = design.calibration
    if not isinstance(cal, MarginCalibration):
        raise ValueError("replicates of any kind are recalibrated on margins; calibration per stratum has calibrated_jackknife")
    return {t: e.cast("double") for t, e in cal.terms.items()}


def calibration_vectors(design: SurveyDesign, measures: dict[str, Column]) -> tuple[DataFrame, int]:
    """Unit vectors of base weights with all that recalibration needs, and their size: y, z, z z', z y."""
    z, y = list(_terms(design).values()), [F.coalesce(e.cast("double"), F.lit(0.0)) for e in measures.values()]
    inside = F.when(design.inside, 1.0).otherwise(0.0)
    own = [e * inside for e in y]
    wanted = [*own, *z, *[z[j] * z[k] for j, k in pairs_of(range(len(z)), 2)], *[x * e for x in z for e in own]]
    plain = replace(design, weight=design.calibration.base, calibration=None, domain=None)
    return unit_vectors(plain, {str(i): e for i, e in enumerate(wanted)}), len(wanted)


def recalibrated(replicates: DataFrame, measures: int, totals: list[float]) -> DataFrame:
    """Replicates of :func:`calibration_vectors` with the weights of each calibrated to ``totals``: cells are those of y."""
    k, p = measures, len(totals)
    want, upper = np.array(totals), np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["cells"].flatten().to_numpy().reshape(batch.num_rows, -1)
            y, z, rest = v[:, :k], v[:, k : k + p], v[:, k + p :]
            gram = np.zeros((len(v), p, p))
            gram[:, upper[0], upper[1]] = rest[:, : len(upper[0])]
            gram[:, upper[1], upper[0]] = rest[:, : len(upper[0])]
            cross = rest[:, len(upper[0]) :].reshape(len(v), p, k)
            size = np.sqrt(np.maximum(np.einsum("bjj->bj", gram), 1e-300))
            # Redundant terms are allowed.
            inverse = np.linalg.pinv(gram / (size[:, :, None] * size[:, None, :]), rcond=1e-11, hermitian=True)
            pull = np.einsum("bj,bjk->bk", (want - z) / size, inverse) / size
            cells = y + np.einsum("bj,bjk->bk", pull, cross)
            yield pa.RecordBatch.from_pydict({c: pa.array(cells.tolist()) if c == "cells" else batch[c] for c in batch.schema.names})

    return replicates.mapInArrow(run, replicates.schema)


def calibrated_jackknife(design: SurveyDesign, measures: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Jackknife replicates in which the calibration is repeated, and the calibrated totals.

    The controls are what the calibrated weights add up to. Calibrated per stratum, only
    the stratum that loses a unit changes, in closed form.
    """
    cal, k = design.calibration, len(measures)
    if isinstance(cal, MarginCalibration):
        terms = list(_terms(design).values())
        w = F.col(design.weight)
        totals = list(design.df.agg(*[F.sum(w * z) for z in terms]).first())  # one number per term
        units, size = calibration_vectors(design, measures)
        rows = recalibrated(jackknife_totals(design, units, size), k, totals)
        return rows, recalibrated(full_totals(units, size).withColumnRenamed("total", "cells"), k, totals).withColumnRenamed("cells", "total")
    if not isinstance(cal, StratumCalibration):
        raise ValueError("the design is not calibrated")
    z = F.lit(1.0) if cal.size is None else F.col(cal.size).cast("double")
    d, w, inside = F.col(cal.base), F.col(design.weight), F.when(design.inside, 1.0).otherwise(0.0)
    y = [F.coalesce(e.cast("double"), F.lit(0.0)) * inside for e in measures.values()]
    sums = [F.array(*[F.sum(d * e) for e in y]).alias("y"), F.array(*[F.sum(d * z * e) for e in y]).alias("zy")]
    sums += [F.array(*[F.sum(w * e) for e in y]).alias("v"), F.sum(d * z).alias("z"), F.sum(d * z * z).alias("zz"), F.sum(w * z).alias("control")]
    units = settle(design.df.groupBy(F.col(design.strata).alias("h"), F.col(design.psu).alias("i")).agg(*sums))
    own = [_sum_vectors(c, k).alias(f"{c}_h") for c in ("y", "zy", "v")]
    strata = units.groupBy("h").agg(F.count("*").alias("n"), *own, *[F.sum(c).alias(f"{c}_h") for c in ("z", "zz", "control")])
    whole = settle(full_totals(units, k))
    rows = join_small(units, strata, ["h"]).join(F.broadcast(whole), F.lit(True))  # one row
    n = F.col("n")
    up = n / (n - 1)
    pull = F.try_divide(F.col("control_h") - (F.col("z_h") - F.col("z")) * up, (F.col("zz_h") - F.col("zz")) * up)

    def left_out(j: int) -> Column:
        kept = (F.col("y_h")[j] - F.col("y")[j]) * up + F.coalesce(pull, F.lit(0.0)) * (F.col("zy_h")[j] - F.col("zy")[j]) * up
        return F.col("total")[j] - F.col("v_h")[j] + kept

    alone = design.lonely_factor(n, F.lit(1.0)) == 0
    cells = F.when(alone, F.col("total")).otherwise(F.array(*[left_out(j) for j in range(k)]))
    rows = rows.select(F.concat_ws(":", "h", F.col("i").cast("string")).alias("rep"), cells.alias("cells"), ((n - 1) / n).alias("factor"))
    return rows, whole


def replicate_variance(replicates: DataFrame, whole: DataFrame, estimates: dict[str, object]) -> DataFrame:
    """Variance of functions of the totals: sum of factor times squared deviation.

    ``estimates`` maps a name to a function of an array column of totals.
    """
    both = replicates.join(F.broadcast(whole), F.lit(True))  # one row
    aggs = []
    for name, f in estimates.items():
        deviation = f(F.col("cells")) - f(F.col("total"))
        aggs += [
            F.max(f(F.col("total"))).alias(f"e_{name}"),
            F.sum(F.col("factor") * deviation * deviation).alias(f"v_{name}"),
        ]
    row = both.agg(*aggs)
    entries = [
        F.struct(
            F.lit(n).alias("stat"),
            F.col(f"e_{n}").alias("estimate"),
            F.col(f"v_{n}").alias("var"),
            F.sqrt(f"v_{n}").alias("se"),
        )
        for n in estimates
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
