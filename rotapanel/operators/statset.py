"""A listed set of statistics with their full covariance matrix.

One row holds the estimates as an array and the covariances as a packed triangle (see ``moments``), so hundreds
of statistics cost no more expressions than two. Linear functions and ratios map the row to another one.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.operators.design import MarginCalibration, SurveyDesign
from rotapanel.operators.moments import domain_covariances, packed, packed_place, settled_variances, unpacked

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def propagated(jacobian: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Covariances of linear functions; a variance that is zero but for rounding is zero."""
    return settled_variances(jacobian @ cov @ jacobian.T, np.einsum("ij,jk,ik->i", np.abs(jacobian), np.abs(cov), np.abs(jacobian)))


class StatSet:
    """Estimates and covariances: ``total`` and ``cov`` of each row, in the order of ``names``."""

    def __init__(self, row: DataFrame, names: list[str]):
        self.row, self.names = row, names
        self._at = {n: k for k, n in enumerate(names)}

    def est(self, name: str) -> Column:
        return F.col("total")[self._at[name]]

    def cov(self, a: str, b: str) -> Column:
        return F.col("cov")[packed_place(self._at[a], self._at[b], len(self.names))]

    def estimates(self) -> DataFrame:
        """(stat, estimate, se) rows."""
        k, keys = len(self.names), [c for c in self.row.columns if c not in ("total", "cov")]
        rows = self.row.select(*keys, "cov", F.posexplode("total").alias("_at", "estimate"))
        at = F.col("_at")
        variance = F.get(F.col("cov"), (at * k - (at * (at - 1) / 2)).cast("int"))
        return rows.select(*keys, self._name(at).alias("stat"), "estimate", F.sqrt(variance).alias("se"))

    def vcov(self, names: list[str] | None = None) -> DataFrame:
        """(stat_a, stat_b, cov) rows, both triangles."""
        k, own = len(self.names), [self._at[n] for n in names or self.names]
        keys = [c for c in self.row.columns if c not in ("total", "cov")]
        rows = self.row.select(*keys, "cov", F.explode(F.lit(own)).alias("_a")).select("*", F.explode(F.lit(own)).alias("_b"))
        low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
        place = (low * k - (low * (low - 1) / 2) + high - low).cast("int")
        return rows.select(*keys, self._name(F.col("_a")).alias("stat_a"), self._name(F.col("_b")).alias("stat_b"), F.get(F.col("cov"), place).alias("cov"))

    def _name(self, at: Column) -> Column:
        return F.get(F.lit(self.names), at)

    def _mapped(self, names: list[str], new: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> StatSet:
        """Functions of the estimates: ``new`` gives their values and the Jacobian."""
        k, out = len(self.names), self.row.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for total, cov in zip(batch["total"].to_pylist(), batch["cov"].to_pylist()):
                    value, jacobian = new(np.array(total))
                    found.append((value, packed(propagated(jacobian, unpacked(np.array(cov), k)))))
                columns = {c: batch[c] for c in batch.schema.names}
                columns["total"], columns["cov"] = (
                    pa.array([[None if np.isnan(x) else x for x in f[i].tolist()] for f in found], pa.list_(pa.float64())) for i in (0, 1)
                )
                yield pa.RecordBatch.from_pydict(columns)

        return StatSet(self.row.mapInArrow(run, out), names)

    def combine(self, outputs: dict[str, dict[str, float]]) -> StatSet:
        """Linear contrasts, each a dict of coefficients by statistic."""
        matrix = np.zeros((len(outputs), len(self.names)))
        for row, coefficients in enumerate(outputs.values()):
            for name, c in coefficients.items():
                matrix[row, self._at[name]] += c
        return self._mapped(list(outputs), lambda total: (matrix @ total, matrix))

    def ratios(self, outputs: dict[str, tuple[str, str]]) -> StatSet:
        """Ratios (numerator, denominator) with linearised covariances."""
        k = len(self.names)
        top, bottom = (np.array([self._at[pair[i]] for pair in outputs.values()], int) for i in (0, 1))
        at = np.arange(len(outputs))

        def new(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.where(total[bottom] == 0, np.nan, total[bottom])
            value, jacobian = total[top] / size, np.zeros((len(outputs), k))
            np.add.at(jacobian, (at, top), 1 / size)
            np.add.at(jacobian, (at, bottom), -value / size)
            return value, jacobian

        return self._mapped(list(outputs), new)

    def block(self, names: list[str]) -> DataFrame:
        """Variance of a sum of statistics, split into its diagonal and the rest."""
        places = [packed_place(self._at[n], self._at[n], len(self.names)) for n in names]
        diagonal = self.row.select(F.aggregate(F.transform(F.lit(places), lambda p: F.get(F.col("cov"), p)), F.lit(0.0), lambda a, b: a + b).alias("var_diag"))
        whole = self.combine({"total": dict.fromkeys(names, 1.0)})
        row = whole.row.select(whole.est("total").alias("total"), whole.cov("total", "total").alias("var_total"))
        return row.join(diagonal, F.lit(True)).selectExpr(  # one row each
            "total", "var_total", "var_diag", "var_total - var_diag AS var_cov", "sqrt(var_total) AS se"
        )


def reduced(design: SurveyDesign, keys: list[str]) -> SurveyDesign:
    """The design with one row per unit and combination of ``keys``.

    Its weights are summed and ``_rows`` counts the persons. Totals of
    measures that depend on ``keys`` alone are the same, but the cells are
    told apart on the reduced rows and not on every person.
    """
    cal = design.calibration
    if isinstance(cal, MarginCalibration) or (cal is not None and cal.size is not None):
        raise ValueError("only plain weights and calibration to stratum counts can be reduced")
    sums = [F.sum(design.weight).alias(design.weight), F.count(F.lit(1)).alias("_rows")]
    if cal is not None:
        sums.append(F.sum(cal.base).alias(cal.base))
    rows = design.df.withColumn("_inside", design.inside)
    grouped = rows.groupBy(design.strata, design.psu, "_inside", *keys).agg(*sums)
    return replace(design, df=grouped, domain=F.col("_inside"))


def stat_set(design: SurveyDesign, measures: dict[str, Column], by: list[str] | None = None) -> StatSet:
    """Weighted totals of ``measures`` (NULL counts as 0) and their covariances; one row, or one per domain."""
    return StatSet(domain_covariances(design, measures, by), list(measures))


def level_measures(
    levels: dict[str, Column], measures: dict[str, Column] | None = None
) -> dict[str, Column]:
    """Measures restricted to each level: ``level`` or ``level|measure``."""
    if measures is None:
        return {n: F.when(c, 1.0) for n, c in levels.items()}
    return {f"{n}|{m}": F.when(c, e) for n, c in levels.items() for m, e in measures.items()}


def domain_means(design: SurveyDesign, y: Column, levels: dict[str, Column]) -> StatSet:
    """Means per listed domain with their covariance matrix."""
    known = F.when(y.isNotNull(), 1.0)
    totals = stat_set(design, level_measures(levels, {"y": y, "n": known}))
    return totals.ratios({d: (f"{d}|y", f"{d}|n") for d in levels})


def joint_proportions(design: SurveyDesign, cells: dict[str, Column]) -> StatSet:
    """Share of each cell in the weighted size of all rows, with covariances."""
    totals = stat_set(design, {**level_measures(cells), "_all": F.lit(1.0)})
    return totals.ratios({c: (c, "_all") for c in cells})
