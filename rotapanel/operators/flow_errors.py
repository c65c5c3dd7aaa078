"""Errors, tests and optimality of fitted flow models, from one pass and one fit per domain.

The estimates are functions of the weighted cells. Differentiating the score equations of the pseudo likelihood
gives the influence of every cell on every parameter; with the design covariances of the cells (see
``moments``) this is the sandwich variance, without refits. Parameters at a bound (a response probability of 0 or 1, a
flow of 0) are held there: the equations are solved for the free ones, with the sum of the flows kept at 1.

Chi-squared follows the second-order correction of Rao and Scott: the statistic is a sum of squares weighted by the
eigenvalues of the design-effect matrix of the residual cells, and is referred to a chi-squared of matching mean and variance.

A domain is one row of (G+1)^2 cells with their covariances; rows are fitted where they lie.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.functions.distributions import chi2_above, chi2_point
from rotapanel.operators.design import MarginCalibration, SurveyDesign
from rotapanel.operators.markov import MODELS, _along, cell_measures, degrees_of_freedom, fit_tables
from rotapanel.operators.moments import domain_covariances, unpacked
from rotapanel.operators.statset import propagated, reduced

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOUND, SLOPE = 1e-9, 1e-6  # what counts as at a bound, and as a slope of zero


@dataclass
class Likelihood:
    """Cell probabilities of a model with their first and second derivatives in all parameters.

    Parameters are the flows f (row by row), then psi, rho_RR and rho_MM.
    """

    names: list[tuple[str, int | None, int | None]]
    value: np.ndarray
    p: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def at(cls, f: np.ndarray, response: list[np.ndarray], axes: tuple[str, str, str]) -> Likelihood:
        g = len(f)
        names: list = [("f", i, j) for i in range(g) for j in range(g)]
        values, start = [f.ravel()], []
        for name, axis, r in zip(("psi", "rho_rr", "rho_mm"), axes, response):
            start.append(len(names))
            own = _along(axis, r[None])[0][0]
            names += [(name, k if axis == "i" else None, k if axis == "j" else None) for k in range(len(own))]
            values.append(own)
        value, size = np.concatenate(values), (g + 1) ** 2
        p, first, second = np.zeros(size), np.zeros((size, len(names))), np.zeros((size, len(names), len(names)))
        for i in range(g):
            for j in range(g):
                flow = i * g + j
                psi, rr, mm = (s + {"": 0, "i": i, "j": j}[axis] for s, axis in zip(start, axes))
                # Each part of a flow is f times two response factors: value and sign of either.
                parts = [
                    (i * (g + 1) + j, psi, 1, rr, 1), (i * (g + 1) + g, psi, 1, rr, -1),
                    (g * (g + 1) + j, psi, -1, mm, -1), (size - 1, psi, -1, mm, 1),
                ]
                for cell, a, sa, b, sb in parts:
                    x, u, v = value[flow], value[a] if sa > 0 else 1 - value[a], value[b] if sb > 0 else 1 - value[b]
                    p[cell] += x * u * v
                    for at, d in ((flow, u * v), (a, sa * x * v), (b, sb * x * u)):
                        first[cell, at] += d
                    for at, to, d in ((flow, a, sa * v), (flow, b, sb * u), (a, b, sa * sb * x)):
                        second[cell, at, to] += d
                        second[cell, to, at] += d
        return cls(names, value, p, first, second)

    def slope(self, t: np.ndarray) -> np.ndarray:
        """Gradient of the mean log likelihood, less that of the constraint that flows sum to 1 (whose multiplier is 1)."""
        seen = t > 0
        flows = np.array([n[0] == "f" for n in self.names], float)
        return (t[seen] / self.p[seen]) @ self.first[seen] - flows

    def held(self, fixed: np.ndarray) -> np.ndarray:
        """Parameters at a bound: -1 at 0, 1 at 1, 2 fixed by assumption, else 0."""
        out = np.where(self.value <= BOUND, -1, np.where(self.value >= 1 - BOUND, 1, 0))
        out[: len(fixed)] = np.where(fixed, 2, out[: len(fixed)])
        return out

    def influence(self, t: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, bool]:
        """Derivatives of all parameters in the cells' shares, and whether the cells determine the parameters."""
        seen, free = t > 0, np.flatnonzero(held == 0)
        p, first = self.p[seen], self.first[seen][:, free]
        score = first / p[:, None]
        bend = np.einsum("k,kab->ab", t[seen] / p, self.second[seen][:, free][:, :, free]) - (score * t[seen][:, None]).T @ score
        border = np.array([self.names[k][0] == "f" for k in free], float)
        system = np.block([[bend, -border[:, None]], [border[None], np.zeros((1, 1))]])
        size = np.sqrt(np.maximum(np.abs(system).max(1), 1e-300))
        scaled = system / np.outer(size, size)
        known = np.linalg.matrix_rank(scaled, tol=1e-9) == len(scaled)
        right = np.zeros((len(system), len(t)))
        # A cell without observations can't pull on what is held at its bound.
        every = np.divide(self.first[:, free], self.p[:, None], out=np.zeros((len(t), len(free))), where=self.p[:, None] > 0)
        right[:-1] = -every.T
        solved = np.linalg.pinv(scaled, rcond=1e-10) @ (right / size[:, None]) / size[:, None]
        out = np.zeros((len(self.names), len(t)))
        out[free] = solved[:-1]
        return out, known


def _fit(cells: np.ndarray, g: int, model: str, zero_flows: bool) -> tuple[Likelihood, np.ndarray, np.ndarray, bool]:
    """Likelihood at the fit, shares of the cells, held parameters, and whether the fit ended."""
    table = cells.reshape(1, g + 1, g + 1)
    fit = fit_tables(table, model, zero_flows, tol=1e-12)
    total = cells.sum()
    at = Likelihood.at(fit["muij"][0] / total, [fit[c][0] for c in ("psi", "rho_rr", "rho_mm")], MODELS[model])
    fixed = (table[0, :g, :g] <= 0).ravel() if zero_flows else np.zeros(g * g, bool)
    return at, cells / total, at.held(fixed), bool(fit["converged"][0])


def _derived(at: Likelihood, g: int, total: float, population: float | None) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Names and values of the reported parameters, their derivatives in the parameters and, at fixed ones, in the total."""
    f = at.value[: g * g].reshape(g, g)
    size = total if population is None else population
    eta, rows = f.sum(1), []
    width = len(at.names)

    def add(name: str, i, j, value: float, slopes: dict[int, float], in_total: float = 0.0) -> None:
        line = np.zeros(width)
        for k, s in slopes.items():
            line[k] += s
        rows.append(((name, i, j), value, line, in_total))

    for i in range(g):
        add("eta", i, None, eta[i], {i * g + j: 1.0 for j in range(g)})
    for j in range(g):
        add("gamma", None, j, f[:, j].sum(), {i * g + j: 1.0 for i in range(g)})
    for i in range(g):
        for j in range(g):
            share = f[i, j] / eta[i] if eta[i] > 0 else 0.0
            add("pij", i, j, share, {i * g + k: ((k == j) - share) / eta[i] if eta[i] > 0 else 0.0 for k in range(g)})
    for i in range(g):
        for j in range(g):
            add("muij", i, j, f[i, j] * size, {i * g + j: size}, f[i, j] if population is None else 0.0)
    for k in range(g * g, width):
        add(*at.names[k], at.value[k], {k: 1.0})
    names, values, slopes, in_total = zip(*rows)
    return list(names), np.array(values), np.array(slopes), np.array(in_total)


def _cells(design: SurveyDesign, s1: str, s2: str, levels: list, by: list[str], persons: bool = False) -> DataFrame:
    """Totals of the cells and their covariances per domain; with ``persons`` also the number of persons, ``n``."""
    cal = design.calibration
    small = not isinstance(cal, MarginCalibration) and (cal is None or cal.size is None)
    own = reduced(design, [s1, s2, *by]) if small else design.mutate(_rows=F.lit(1))
    cells = domain_covariances(own, cell_measures(s1, s2, levels), by)
    if not persons:
        return cells
    n = own.df.where(own.inside).groupBy(*by).agg(F.sum("_rows").alias("n"))
    if not by:
        return cells.join(n, F.lit(True))  # one row each
    pairs = [(c, f"_{c}") for c in by]
    n = n.withColumnsRenamed(dict(pairs))
    same = None
    for a, b in pairs:
        one = F.col(a).eqNullSafe(F.col(b))
        same = one if same is None else same & one
    return cells.join(n, same).drop(*[b for _, b in pairs])


def _per_model(rows: DataFrame, models: list[str], by: list[str], schema: str, found) -> DataFrame:
    """Rows of ``found(row, model)`` for every domain and model."""
    rows = rows.withColumn("model", F.explode(F.lit(models)))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = pd.DataFrame(found(row))
                for pos, c in enumerate(by):
                    out.insert(pos, c, [getattr(row, c)] * len(out))
                out.insert(len(by), "model", row.model)
                yield out

    return rows.mapInPandas(run, f"{kinds}model string, {schema}")


def flow_errors(
    design: SurveyDesign, s1: str, s2: str, levels: list, models: list[str] | None = None, by: list[str] | None = None,
    zero_flows: bool = True, population: float | None = None,
) -> DataFrame:
    """(by..., model, param, i, j, value, se, at_bound, determined, converged): parameters with linearised errors.

    Calibrated designs give the errors of the calibrated weights. ``population`` is the known size
    that flows are scaled to; else it is the weights' own sum, whose error counts. The error is null where the
    cells don't determine the parameters, and 0 for those held at a bound.
    """
    by, g, states = by or [], len(levels), [str(x) for x in levels]

    def found(row) -> list[dict]:
        cells, cov = np.array(row.total), unpacked(np.array(row.cov), (g + 1) ** 2)
        total = cells.sum()
        at, t, held, converged = _fit(cells, g, row.model, zero_flows)
        influence, known = at.influence(t, held)
        names, values, slopes, in_total = _derived(at, g, total, population)
        jacobian = slopes @ influence / total + in_total[:, None]
        spread = np.diag(propagated(jacobian, cov))
        bound = {at.names[k]: bool(held[k]) for k in range(g * g, len(held))}
        return [
            {"param": n, "i": None if i is None else states[i], "j": None if j is None else states[j], "value": float(v),
             "se": float(np.sqrt(s)) if known else None, "at_bound": bound.get((n, i, j), False), "determined": known, "converged": converged}
            for (n, i, j), v, s in zip(names, values, spread)
        ]

    schema = "param string, i string, j string, value double, se double, at_bound boolean, determined boolean, converged boolean"
    return _per_model(_cells(design, s1, s2, levels, by), models or list(MODELS), by, schema, found)


def certificates(arrays: DataFrame, levels: list, models: list[str] | None = None, by: list[str] | None = None, zero_flows: bool = True) -> DataFrame:
    """(by..., model, param, i, j, value, slope, bound, holds, loglik) per parameter of ``cells`` arrays.

    A fit is a maximum only if no allowed move raises the likelihood: ``slope`` is zero inside, not above zero at 0 and not below it
    at 1 (``bound`` is 0 or 1 there). Flows fixed at zero by assumption are left out. ``loglik`` is the mean log likelihood reached.
    """
    by, g, states = by or [], len(levels), [str(x) for x in levels]

    def found(row) -> list[dict]:
        cells = np.array(row.cells, float)
        at, t, held, _ = _fit(cells, g, row.model, zero_flows)
        slope, seen = at.slope(t), t > 0
        reached = float((t[seen] * np.log(at.p[seen])).sum())
        holds = np.where(held == 0, np.abs(slope) <= SLOPE, np.where(held < 0, slope <= SLOPE, slope >= -SLOPE))
        return [
            {"param": n, "i": None if i is None else states[i], "j": None if j is None else states[j], "value": float(at.value[k]),
             "slope": float(slope[k]), "bound": {0: None, -1: 0.0, 1: 1.0}[int(held[k])], "holds": bool(holds[k]), "loglik": reached}
            for k, (n, i, j) in enumerate(at.names) if held[k] != 2
        ]

    schema = "param string, i string, j string, value double, slope double, bound double, holds boolean, loglik double"
    return _per_model(arrays.select(*by, "cells"), models or list(MODELS), by, schema, found)


def design_effects(at: Likelihood, t: np.ndarray, held: np.ndarray, cov: np.ndarray, n: float) -> tuple[int, np.ndarray]:
    """Residual degrees of freedom, and the eigenvalues of the design-effect matrix of the cells' residuals.

    A residual is linear in the shares ``t`` of the cells, whose covariance is ``cov``: the share's own
    move less that of the fitted cell. Under simple sampling and an exact fit as many are 1 as
    there are degrees of freedom, and the others 0.
    """
    influence, _ = at.influence(t, held)
    free, present = np.flatnonzero(held == 0), at.p > 0
    residual = np.eye(len(t)) - at.first @ influence
    root = np.sqrt(at.p[present])
    spread = n * (residual @ cov @ residual.T)[np.ix_(present, present)] / np.outer(root, root)
    # The fitted cells move in as many directions as there are free parameters; they and the shares' sum are no residuals.
    moves = int(np.linalg.matrix_rank(at.first[:, free] @ influence[free], tol=1e-9))
    return max(int(present.sum()) - 1 - moves, 0), np.maximum(np.linalg.eigvalsh(spread)[::-1], 0.0)


def model_tests(
    design: SurveyDesign, s1: str, s2: str, levels: list, models: list[str] | None = None, by: list[str] | None = None, zero_flows: bool = True
) -> DataFrame:
    """(by..., model, chi2, df, deff, chi2_rs, df_rs, critical, p, n, converged, chosen): second-order tests of fit.

    ``df`` counts cells less free parameters: those at a bound are not free. The corrected statistic has ``df_rs`` degrees of
    freedom, not whole ones; the residuals' own covariances give it, so it may pass ``df`` where a model doesn't fit exactly. ``chosen`` marks the best fit: the largest p value, and of equal ones the model
    with the fewest parameters; a model without degrees of freedom has no p value and is chosen only if there is no other.
    """
    by, g = by or [], len(levels)

    def found(row) -> list[dict]:
        cells, n = np.array(row.total), float(row.n)
        at, t, held, converged = _fit(cells, g, row.model, zero_flows)
        share = (np.eye(len(cells)) - t[:, None]) / cells.sum()
        df, effects = design_effects(at, t, held, propagated(share, unpacked(np.array(row.cov), len(cells))), n)
        ok = at.p > 0
        chi2 = float(n * ((t[ok] - at.p[ok]) ** 2 / at.p[ok]).sum())
        first, second = effects.sum(), (effects**2).sum()
        tested = df > 0 and first > 0
        corrected, df_rs = (chi2 * first / second, first**2 / second) if tested else (None, None)
        return [{
            "chi2": chi2, "df": df, "deff": float(first / df) if df else None, "chi2_rs": corrected, "df_rs": df_rs,
            "n": int(n), "converged": converged, "order": -degrees_of_freedom(row.model, g),
        }]

    schema = "chi2 double, df int, deff double, chi2_rs double, df_rs double, n long, converged boolean, order int"
    out = _per_model(_cells(design, s1, s2, levels, by, persons=True), models or list(MODELS), by, schema, found)
    out = out.withColumns({"critical": chi2_point("df_rs"), "p": chi2_above("chi2_rs", "df_rs")})
    ranked = Window.partitionBy(*by, F.lit(0)).orderBy(F.col("p").desc_nulls_last(), "order", "model")  # a row for each model
    out = out.withColumn("chosen", F.row_number().over(ranked) == 1)
    return out.select(*by, "model", "chi2", "df", "deff", "chi2_rs", "df_rs", "critical", "p", "n", "converged", "chosen")
