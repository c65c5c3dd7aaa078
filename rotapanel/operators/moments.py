"""Covariances of many weighted totals, as packed arrays.

A unit's sums are one array, and a domain's result is one row: its totals and the upper triangle of their
covariance matrix. Moments are centred and merged (count, mean, products about the mean), so large totals
with little spread keep their digits and no variance falls below zero by rounding.

Units come sorted by domain and stratum; a task goes through them keeping the moments of the stratum at
hand and the sums of the domain so far. A stratum of more than ``SPLIT`` units is dealt to several tasks,
whose moments are merged. Units of a stratum without a row in the domain count as zeros, in closed form.

With calibrated weights the covariances are those of the residuals, which follow from the same pass: the
products of statistics with the calibration terms (centred per stratum) come along with the moments.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement as pairs_of

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rotapanel.operators.calibration import solved
from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.session import join_small, settle

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 20_000  # units of a stratum in one task
ROUNDING = 1e-12


def packed_size(k: int) -> int:
    return k * (k + 1) // 2


def packed(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def unpacked(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


def packed_place(i: int, j: int, k: int) -> int:
    """Where the pair (i, j) of k statistics stands."""
    i, j = min(i, j), max(i, j)
    return i * k - i * (i - 1) // 2 + j - i


def settled_variances(cov: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sets variances that are below zero by rounding alone to zero; ``size`` is what they were added up from."""
    spread = np.diag(cov).copy()
    spread[(spread < 0) & (spread > -ROUNDING * size)] = 0.0
    np.fill_diagonal(cov, spread)
    return cov


@dataclass
class Moments:
    """Units of a stratum: number, mean and products about the mean of their sums; and with calibration
    terms the products of sums and terms, and the slopes' numerators."""

    n: float
    mean: np.ndarray
    about: np.ndarray
    cross: np.ndarray
    slope: np.ndarray

    @classmethod
    def of(cls, y: np.ndarray, z: np.ndarray, b: np.ndarray) -> Moments:
        mean = y.mean(0)
        e = y - mean
        return cls(len(y), mean, e.T @ e, y.T @ z, b.sum(0).reshape(y.shape[1], -1))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n, self.mean + gap * (other.n / n), self.about + other.about + np.outer(gap, gap) * (self.n * other.n / n),
            self.cross + other.cross, self.slope + other.slope,
        )

    def with_zeros(self, n: float) -> np.ndarray:
        """Products about the mean of n units, those not seen being zero."""
        return self.about + np.outer(self.mean, self.mean) * (self.n * (n - self.n) / n)


def _finished(m: Moments, n: float, scale: float, square: float | None, spread: float | None) -> tuple[np.ndarray, ...]:
    """Totals, covariances, scaled cross products and slopes of a whole stratum."""
    cov = m.with_zeros(n)
    if square is not None:
        # Calibrated per stratum: one term, and the slopes are the stratum's own.
        b = m.slope[:, 0] / square if square else np.zeros(len(m.mean))
        both, square_of_b = np.outer(b, m.cross[:, 0]), np.outer(b, b) * spread
        size = np.diag(cov) + 2 * np.abs(np.diag(both)) + np.diag(square_of_b)
        cov = settled_variances(cov - both - both.T + square_of_b, size)
    return m.mean * m.n, scale * cov, scale * m.cross, m.slope


def _unit_rows(design: SurveyDesign, by: list[str], measures: dict[str, Column]) -> tuple[DataFrame, DataFrame, int]:
    """Units with their sums per domain, strata with their size and terms, and the number of terms."""
    cal, w, inside = design.calibration, F.col(design.weight), design.inside
    terms: list[Column] = []
    if isinstance(cal, StratumCalibration):
        terms = [F.lit(1.0) if cal.size is None else F.col(cal.size).cast("double")]
    elif isinstance(cal, MarginCalibration):
        terms = [e.cast("double") for e in cal.terms.values()]
    rows = design.df.withColumns({f"_z{j}": z for j, z in enumerate(terms)} | {"_in": inside})
    z = [F.col(f"_z{j}") for j in range(len(terms))]
    zero = F.lit(0.0)
    value = [F.coalesce(e.cast("double"), zero) for e in measures.values()]
    aggs = [F.array(*[F.coalesce(F.sum(w * v), zero) for v in value]).alias("y")]
    pairs = list(pairs_of(range(len(z)), 2))
    if terms:
        base = F.col(cal.base)
        aggs += [F.array(*[F.coalesce(F.sum(base * v * x), zero) for v in value for x in z]).alias("b")]
        aggs += [F.sum(w * x).alias(f"z{j}") for j, x in enumerate(z)]
        aggs += [F.sum(base * z[j] * z[k]).alias(f"g{j}_{k}") for j, k in pairs]
    keys = [F.when(F.col("_in"), F.col(c)).alias(c) for c in by]
    units = rows.groupBy(F.col(design.strata).alias("h"), F.col(design.psu).alias("i"), F.col("_in").alias("inside"), *keys).agg(*aggs)
    units = settle(units)
    per_unit = units.groupBy("h", "i").agg(
        *[F.sum(f"z{j}").alias(f"z{j}") for j in range(len(z))], *[F.sum(f"g{j}_{k}").alias(f"g{j}_{k}") for j, k in pairs], F.lit(1).alias("one")
    )
    strata = per_unit.groupBy("h").agg(
        F.count("*").cast("double").alias("n"), *[F.avg(f"z{j}").alias(f"m{j}") for j in range(len(z))],
        *[(F.covar_pop(f"z{j}", f"z{k}") * F.count("*")).alias(f"q{j}_{k}") for j, k in pairs],
        *[F.sum(f"g{j}_{k}").alias(f"g{j}_{k}") for j, k in pairs],
    )
    n = F.col("n")
    strata = strata.withColumn("scale", design.lonely_factor(n, n / (n - 1)))
    if terms:
        unit = Window.partitionBy("h", "i")
        units = units.withColumns({f"z{j}": F.sum(f"z{j}").over(unit) for j in range(len(z))})
    return units.where("inside").drop("inside", *[f"g{j}_{k}" for j, k in pairs]), settle(strata), len(terms)


def _rolled_up(units: DataFrame, by: list[str], sets: list[list[str]], k: int, p: int) -> DataFrame:
    """Unit rows of every grouping set; ``set`` is its number, and factors that it leaves out are NULL."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("set"), *[(F.col(c) if c in own else F.lit(None)).alias(c) for c in by]) for n, own in enumerate(sets)]))
    rows = units.select("*", levels.alias("_level")).drop(*by).select("*", "_level.*")
    sums = [F.array(*[F.sum(F.col("y")[i]) for i in range(k)]).alias("y")]
    if p:
        sums += [F.array(*[F.sum(F.col("b")[i]) for i in range(k * p)]).alias("b")]
        sums += [F.first(f"z{j}").alias(f"z{j}") for j in range(p)]  # the unit's own, the same in all its rows
    return rows.groupBy("h", "i", "set", *by).agg(*sums)


def domain_covariances(
    design: SurveyDesign, measures: dict[str, Column], by: list[str] | None = None, sets: list[list[str]] | None = None
) -> DataFrame:
    """Per domain: ``total`` (one number per measure, NULL counting as 0) and ``cov``, the packed covariances.

    ``sets`` lists grouping sets of ``by``: all their domains come from the same unit rows, and ``set`` numbers them.
    """
    by, cal, k = by or [], design.calibration, len(measures)
    units, strata, p = _unit_rows(design, by, measures)
    if sets is not None:
        units, by = _rolled_up(units, by, sets, k, p), ["set", *by]
    per_stratum = isinstance(cal, StratumCalibration)
    zs = F.array(*[(F.col(f"z{j}") - F.col(f"m{j}")) for j in range(p)]) if p else F.expr("cast(array() AS array<double>)")
    rows = join_small(units, strata.withColumn("slices", F.expr(f"cast(ceil(n / {SPLIT}) AS int)")), ["h"])
    nothing = F.lit(None).cast("double")
    rows = rows.select(
        F.struct(F.lit(0).alias("_"), *by).alias("key"), F.col("h"), F.expr("pmod(hash(i), slices)").alias("slice"), "slices", "n", "scale",
        (F.col("g0_0") if per_stratum else nothing).alias("square"), (F.col("q0_0") if per_stratum else nothing).alias("spread"),
        "y", zs.alias("z"), (F.col("b") if p else F.expr("cast(array() AS array<double>)")).alias("b"),
    )
    vector = T.ArrayType(T.DoubleType())
    done = T.StructType([rows.schema["key"], *(T.StructField(c, vector) for c in ("total", "cov", "cross", "slope"))])
    open_ = T.StructType([
        *(rows.schema[c] for c in ("key", "h", "n", "scale", "square", "spread")), T.StructField("m", T.DoubleType()),
        *(T.StructField(c, vector) for c in ("mean", "about", "cross", "slope")),
    ])
    both = T.StructType([T.StructField("done", done), T.StructField("part", open_)])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None  # the stratum (or slice) at hand and its facts
        now: Moments | None = None
        domain, sums = None, None
        out: list[dict] = []

        def close_stratum() -> None:
            nonlocal sums
            key, h, _, slices, n, scale, square, spread = at
            if slices > 1:
                part = {"key": key, "h": h, "n": n, "scale": scale, "square": square, "spread": spread, "m": float(now.n), "mean": now.mean,
                        "about": packed(now.about), "cross": now.cross.ravel(), "slope": now.slope.ravel()}
                out.append({"done": None, "part": part})
                return
            new = _finished(now, n, scale, square, spread)
            sums = new if sums is None else tuple(a + b for a, b in zip(sums, new))

        def close_domain() -> None:
            nonlocal sums
            if sums is not None:
                total, cov, cross, slope = sums
                out.append({"done": {"key": domain, "total": total, "cov": packed(cov), "cross": cross.ravel(), "slope": slope.ravel()}, "part": None})
            sums = None

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            y = batch["y"].flatten().to_numpy().reshape(size, k)
            z = batch["z"].flatten().to_numpy().reshape(size, p)
            b = batch["b"].flatten().to_numpy().reshape(size, k * p)
            names = ["key", "h", "slice", "slices", "n", "scale", "square", "spread"]
            facts = list(zip(*(batch[c].to_pylist() for c in names)))
            edges = [0, *(r for r in range(1, size) if facts[r][:3] != facts[r - 1][:3]), size]
            for lo, hi in zip(edges, edges[1:]):
                if at is not None and facts[lo][:3] != at[:3]:
                    close_stratum()
                    now = None
                    if facts[lo][0] != domain:
                        close_domain()
                at, domain = facts[lo], facts[lo][0]
                new = Moments.of(y[lo:hi], z[lo:hi], b[lo:hi])
                now = new if now is None else now.merged(new)
            yield from flushed()
        if at is not None:
            close_stratum()
            close_domain()
        yield from flushed()

    def of_slices(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        now = None
        for r in parts:
            new = Moments(r["m"], np.array(r["mean"]), unpacked(np.array(r["about"]), k),
                          np.array(r["cross"]).reshape(k, p), np.array(r["slope"]).reshape(k, p))
            now = new if now is None else now.merged(new)
        first = parts[0]
        total, cov, cross, slope = _finished(now, first["n"], first["scale"], first["square"], first["spread"])
        row = {"key": first["key"], "total": total, "cov": packed(cov), "cross": cross.ravel(), "slope": slope.ravel()}
        return pa.Table.from_pylist([row], schema=to_arrow_schema(done))

    arrow = to_arrow_schema(both)
    keys = ["key", "h", "slice"]
    cores = design.df.sparkSession.sparkContext.defaultParallelism
    first = settle(rows.repartition(cores, *keys).sortWithinPartitions(*keys).mapInArrow(through, both))
    whole = first.where("done IS NOT NULL").select("done.*")
    parts = first.where("part IS NOT NULL").select("part.*").withColumn("_h", F.col("h"))
    slices = parts.groupBy("key", "_h").applyInArrow(lambda t: of_slices(t.drop_columns(["_h"])), done)
    inverse, terms_spread = _margin_system(cal, strata, p) if isinstance(cal, MarginCalibration) else (None, None)

    def of_domain(table: pa.Table) -> pa.Table:
        sums = [np.array([np.asarray(v, float) for v in table[c].to_pylist()]).sum(0) for c in ("total", "cov", "cross", "slope")]
        total, cov, cross, slope = sums
        if inverse is not None:
            b, m = slope.reshape(k, p) @ inverse, cross.reshape(k, p)
            both, own = b @ m.T, unpacked(cov, k)
            size = np.diag(own) + 2 * np.einsum("ij,ij->i", np.abs(b), np.abs(m)) + np.einsum("ij,jk,ik->i", np.abs(b), np.abs(terms_spread), np.abs(b))
            cov = packed(settled_variances(own - both - both.T + b @ terms_spread @ b.T, size))
        return pa.table({"key": table["key"].combine_chunks().slice(0, 1), "total": pa.array([total.tolist()]), "cov": pa.array([cov.tolist()])})

    result = T.StructType([rows.schema["key"], T.StructField("total", vector), T.StructField("cov", vector)])
    out = whole.unionByName(slices).groupBy("key").applyInArrow(of_domain, result)
    return out.select(*[F.col("key").getField(c).alias(c) for c in by], "total", "cov")


def _margin_system(cal: MarginCalibration, strata: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of the terms' products, and the spread of their unit totals; as large as the number of terms."""
    pairs = list(pairs_of(range(p), 2))
    row = strata.agg(
        *[F.sum(f"g{j}_{k}").alias(f"g{j}_{k}") for j, k in pairs], *[F.sum(F.col("scale") * F.col(f"q{j}_{k}")).alias(f"q{j}_{k}") for j, k in pairs]
    ).first()
    gram, spread = np.zeros((p, p)), np.zeros((p, p))
    for j, k in pairs:
        gram[j, k] = gram[k, j] = row[f"g{j}_{k}"]
        spread[j, k] = spread[k, j] = row[f"q{j}_{k}"]
    full = np.linalg.matrix_rank(gram) == p
    return solved(gram, np.eye(p) if full else gram @ np.linalg.pinv(gram), list(cal.terms)), spread
