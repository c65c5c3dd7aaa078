"""Markov flow models with non-response, fitted on flow tables.

Spark reduces the microdata to one array of (G+1)^2 cells per domain and
replicate. Those arrays are fitted in batches; no task sees person rows.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.distributions import chi2_above, chi2_point
from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.replication import calibrated_jackknife, full_totals, jackknife_totals, unit_vectors
from rotapanel.operators.statset import reduced, stat_set
from rotapanel.session import settle

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# On which state a response probability may depend in each model
# ("" none, "i" the first state, "j" the second): psi, rho_RR, rho_MM.
MODELS = {"A": ("", "", ""), "B": ("i", "", ""), "C": ("", "i", "i"), "D": ("", "j", "j")}


def cell_measures(s1: str, s2: str, levels: list) -> dict[str, Column]:
    """Indicators of the (G+1)^2 cells in row order; the last row and column are non-response."""
    a, b = F.col(s1), F.col(s2)
    rows = [*[(str(x), a == x) for x in levels], ("NA", a.isNull())]
    cols = [*[(str(x), b == x) for x in levels], ("NA", b.isNull())]
    return {f"{r}>{c}": F.when(in_row & in_col, 1.0) for (r, in_row), (c, in_col) in product(rows, cols)}


def cell_arrays(base: DataFrame, s1: str, s2: str, levels: list, weight: str, by: list[str] | None = None) -> DataFrame:
    """One row per domain with its weighted cells and its number of persons.

    Cells are summed in long form first and put side by side afterwards.
    """
    by = by or []
    cells = base.groupBy(*by, s1, s2).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    w = F.col("_w")
    parts = [F.sum(F.coalesce(w * e, F.lit(0.0))) for e in cell_measures(s1, s2, levels).values()]
    return cells.groupBy(*by).agg(F.array(*parts).alias("cells"), F.sum("_n").alias("n"))


def _pooled(num: np.ndarray, den: np.ndarray, axis: str) -> np.ndarray:
    """Ratio of sums over all cells, or kept by row or by column; shape (B, G, G)."""
    over = {"": (1, 2), "i": (2,), "j": (1,)}[axis]
    top, bottom = num.sum(over, keepdims=True), den.sum(over, keepdims=True)
    ratio = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
    return np.broadcast_to(ratio, num.shape)


def _share(f: np.ndarray, over: tuple[int, ...]) -> np.ndarray:
    total = f.sum(over, keepdims=True)
    return np.divide(f, total, out=np.zeros_like(f), where=total > 0)


def _fitted_parts(t: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probabilities of the cells before they are summed over what was not answered."""
    f, psi, rr, mm = theta
    return psi * rr * f, psi * (1 - rr) * f, (1 - psi) * (1 - mm) * f, (1 - psi) * mm * f


def _em_step(t: np.ndarray, theta: np.ndarray, axes: tuple[str, str, str]) -> np.ndarray:
    """Complete the table with the current fit, then re-estimate from it."""
    g = t.shape[1] - 1
    _, row_part, col_part, both_part = _fitted_parts(t, theta)
    n = t[:, :g, :g]
    only_row = t[:, :g, g:] * _share(row_part, (2,))
    only_col = t[:, g:, :g] * _share(col_part, (1,))
    neither = t[:, g:, g:] * _share(both_part, (1, 2))
    answered, silent = n + only_row, only_col + neither
    everyone = answered + silent
    psi_axis, rr_axis, mm_axis = axes
    return np.stack(
        [
            _share(everyone, (1, 2)),
            _pooled(answered, everyone, psi_axis),
            _pooled(n, answered, rr_axis),
            _pooled(neither, silent, mm_axis),
        ]
    )


def _cell_probabilities(t: np.ndarray, theta: np.ndarray) -> np.ndarray:
    g = t.shape[1] - 1
    full, row_part, col_part, both_part = _fitted_parts(t, theta)
    out = np.zeros_like(t)
    out[:, :g, :g] = full
    out[:, :g, g] = row_part.sum(2)
    out[:, g, :g] = col_part.sum(1)
    out[:, g, g] = both_part.sum((1, 2))
    return out


def _best_point(
    counts: np.ndarray,
    fixed: np.ndarray,
    slope: np.ndarray,
    x: np.ndarray,
    cost: np.ndarray | float = 0.0,
    upper: float = 1.0,
    sweeps: int = 4,
) -> np.ndarray:
    """Raise sum_k counts_k log(fixed_k + slope_k x) - cost x over 0 <= x <= upper, per table.

    Concave in ``x``, with as many unknowns as states. Newton steps on the
    coordinates that are free to move, halved until the value does not fall.
    """
    seen = counts > 0
    g = x.shape[1]
    cost = np.broadcast_to(np.asarray(cost, dtype=float), x.shape)

    def inner(at: np.ndarray) -> np.ndarray:
        return fixed + np.einsum("bkg,bg->bk", slope, at)

    def value(at: np.ndarray) -> np.ndarray:
        line = inner(at)
        ok = (line > 0) | ~seen
        logs = np.log(line, out=np.zeros_like(line), where=seen & (line > 0))
        return np.where(ok.all(1), (counts * logs).sum(1) - (cost * at).sum(1), -np.inf)

    now = value(x)
    for _ in range(sweeps):
        line = inner(x)
        pull = np.divide(counts, line, out=np.zeros_like(line), where=seen)
        bend = np.divide(pull, line, out=np.zeros_like(line), where=seen)
        gradient = np.einsum("bk,bkg->bg", pull, slope) - cost
        held = ((x <= 0) & (gradient <= 0)) | ((x >= upper) & (gradient >= 0))
        free = ~held
        curve = np.einsum("bk,bkg,bkh->bgh", bend, slope, slope) * (free[:, :, None] & free[:, None, :])
        ridge = 1e-13 * (1 + np.trace(curve, axis1=1, axis2=2))
        curve = curve + (ridge[:, None] + held)[:, :, None] * np.eye(g)
        move = np.linalg.solve(curve, np.where(free, gradient, 0.0)[:, :, None])[:, :, 0]
        length = np.ones(len(x))
        best, reached, open_ = x, now, np.ones(len(x), dtype=bool)
        for _ in range(40):
            trial = np.clip(x + length[:, None] * move, 0.0, upper)
            got = value(trial)
            take = open_ & (got >= now)
            best = np.where(take[:, None], trial, best)
            reached = np.where(take, got, reached)
            open_ &= ~take
            if not open_.any():
                break
            length *= 0.5
        moved = np.abs(best - x).max()
        x, now = best, reached
        if moved < 1e-13:
            break
    return x


def _response_step(t: np.ndarray, theta: np.ndarray, axes: tuple[str, str, str]) -> np.ndarray:
    """Best response probabilities that differ by state, given the rest.

    What is held is the part that answers determine: the transition matrix
    when the first answer depends on the state, the flows of those who went
    on answering when that depends on the new state. Totals are tied by a
    cost per unit of probability in place of the constraint that they sum to 1.
    """
    f, psi, rr, mm = theta
    g = t.shape[1] - 1
    eye = np.broadcast_to(np.eye(g), (len(t), g, g))
    n, r, c, m = t[:, :g, :g], t[:, :g, g], t[:, g, :g], t[:, g, g:]
    zero, none = np.zeros_like(r), np.zeros((len(t), 1))
    lost = np.concatenate([c, m], 1)
    psi_axis, rr_axis, mm_axis = axes

    def by_row(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x[:, :, None], f.shape)

    def by_column(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x[:, None, :], f.shape)

    if psi_axis == "i":
        # Those silent at first, by state; the others are known by state.
        p = _share(f, (2,))
        told = n.sum(2) + r
        slope = np.concatenate([p.transpose(0, 2, 1), np.ones((len(t), 1, g))], 1)
        start = (f * (1 - psi)).sum(2)
        silent = _best_point(lost, np.zeros_like(lost), slope, start, cost=1.0)
        f = _share((told + silent)[:, :, None] * p, (1, 2))
        psi = by_row(np.divide(told, told + silent, out=np.ones_like(told), where=told + silent > 0))
    if rr_axis == "j":
        # Odds of falling silent, by new state, for given flows of those who went on.
        kept = f * rr
        size = kept.sum(1)
        odds = (1 - rr[:, 0, :]) / np.maximum(rr[:, 0, :], 1e-12)
        counts = np.concatenate([r, lost], 1)
        never = mm[:, 0, :] * size
        fixed = np.concatenate([zero, np.ones_like(c), never.sum(1)[:, None]], 1)
        slope = np.concatenate([kept, eye, never[:, None, :]], 1)
        odds = _best_point(counts, fixed, slope, odds, cost=size, upper=1e9)
        f = _share(kept * (1 + odds)[:, None, :], (1, 2))
        rr = by_column(1 / (1 + odds))
    silent = f * (1 - psi)
    if mm_axis == "i":
        fixed = np.concatenate([silent.sum(1), none], 1)
        slope = np.concatenate([-silent.transpose(0, 2, 1), silent.sum(2)[:, None, :]], 1)
        mm = by_row(_best_point(lost, fixed, slope, mm[:, :, 0]))
    elif mm_axis == "j":
        total = silent.sum(1)
        fixed = np.concatenate([total, none], 1)
        slope = np.concatenate([-total[:, :, None] * eye, total[:, None, :]], 1)
        mm = by_column(_best_point(lost, fixed, slope, mm[:, 0, :]))
    return np.stack([f, psi, rr, mm])


def fit_tables(
    tables: np.ndarray, model: str, zero_flows: bool = True, tol: float = 1e-11, max_iter: int = 5_000
) -> dict[str, np.ndarray]:
    """Maximum likelihood estimates for a batch of (G+1) x (G+1) tables of cells.

    The known part of each table is completed by spreading the row
    complement over columns, the column complement over rows and the corner
    over all cells, in proportion to the current fit (EM). Steps of plain EM
    get very short when response probabilities lie near 0, so each is
    followed by the best response probabilities for the current flows.
    """
    axes = MODELS[model]
    g = tables.shape[1] - 1
    scale = tables.sum((1, 2), keepdims=True)
    t = tables / np.where(scale > 0, scale, 1)
    n = t[:, :g, :g]
    start = np.where(n > 0, 1.0, 0.0) if zero_flows else np.ones_like(n)
    f = _share(start * (n + 1.0 / g**2), (1, 2))
    theta = np.stack([f, *(np.full_like(n, x) for x in (0.9, 0.9, 0.5))])
    used = np.zeros(len(t), dtype=int)
    live = np.arange(len(t))
    for _ in range(max_iter):
        before = theta[:, live]
        after = _response_step(t[live], _em_step(t[live], before, axes), axes)
        theta[:, live] = after
        used[live] += 1
        live = live[np.abs(after - before).max((0, 2, 3)) >= tol]
        if not len(live):
            break
    converged = np.ones(len(t), dtype=bool)
    converged[live] = False
    f, psi, rr, mm = theta
    return {
        "eta": f.sum(2),
        "gamma": f.sum(1),
        "pij": _share(f, (2,)),
        "muij": f * scale,
        "psi": psi,
        "rho_rr": rr,
        "rho_mm": mm,
        "fitted": _cell_probabilities(t, theta),
        "observed": t,
        "iterations": used,
        "converged": converged,
    }


def _along(axis: str, values: np.ndarray) -> tuple[np.ndarray, bool, bool]:
    """Distinct values of a response probability and whether they carry i or j."""
    if axis == "i":
        return values[:, :, 0], True, False
    if axis == "j":
        return values[:, 0, :], False, True
    return values[:, :1, 0], False, False


def _parameters(fit: dict[str, np.ndarray], model: str, levels: list, size: np.ndarray) -> pd.DataFrame:
    """Long table of parameters, ``row`` giving the position in the batch."""
    g, batch = len(levels), len(size)
    names = np.array([str(x) for x in levels], dtype=object)
    out = []

    def add(param: str, i, j, values: np.ndarray) -> None:
        k = values.shape[1]
        out.append(
            pd.DataFrame(
                {
                    "row": np.repeat(np.arange(batch), k),
                    "param": param,
                    "i": np.tile(i if i is not None else np.array([None] * k, dtype=object), batch),
                    "j": np.tile(j if j is not None else np.array([None] * k, dtype=object), batch),
                    "value": values.reshape(-1),
                }
            )
        )

    add("eta", names, None, fit["eta"])
    add("gamma", None, names, fit["gamma"])
    rows, cols = np.repeat(names, g), np.tile(names, g)
    add("pij", rows, cols, fit["pij"].reshape(batch, -1))
    scaled = fit["muij"] / fit["muij"].sum((1, 2), keepdims=True) * size[:, None, None]
    add("muij", rows, cols, scaled.reshape(batch, -1))
    for param, axis in zip(("psi", "rho_rr", "rho_mm"), MODELS[model]):
        values, by_i, by_j = _along(axis, fit[param])
        add(param, names if by_i else None, names if by_j else None, values)
    return pd.concat(out, ignore_index=True)


def fit_flow_model(
    arrays: DataFrame,
    levels: list,
    model: str = "C",
    by: list[str] | None = None,
    zero_flows: bool = True,
    population: str | None = None,
    tol: float = 1e-12,
) -> DataFrame:
    """Parameters (param, i, j, value) per row of ``arrays``.

    ``population`` names a column that scales the flows; else the cells' sum
    does. Rows are independent, so Spark may split them in any way.
    """
    keys = by or []
    g = len(levels)
    picked = arrays.select(*keys, "cells", *([population] if population else []))
    schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keys)
    schema = (schema + ", " if schema else "") + (
        "param string, i string, j string, value double, iterations int, converged boolean"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            tables = np.array(pdf["cells"].tolist(), dtype=float).reshape(-1, g + 1, g + 1)
            fit = fit_tables(tables, model, zero_flows, tol)
            size = pdf[population].to_numpy(float) if population else tables.sum((1, 2))
            long = _parameters(fit, model, levels, size)
            at = long.pop("row").to_numpy()
            for pos, c in enumerate(keys):
                long.insert(pos, c, pdf[c].to_numpy()[at])
            long["iterations"] = fit["iterations"][at].astype("int32")
            long["converged"] = fit["converged"][at]
            yield long

    return picked.mapInPandas(run, schema)


def flow_standard_errors(
    design: SurveyDesign,
    s1: str,
    s2: str,
    levels: list,
    model: str = "C",
    zero_flows: bool = True,
    tol: float = 1e-10,
) -> DataFrame:
    """Parameters with jackknife standard errors over the sampling units.

    ``converged`` tells whether the fits of all replicates ended. Calibrated weights are calibrated
    again in every replicate. ``flow_errors`` gives linearised errors from one fit.

    One replicate per unit; the replicates' cells follow in closed form from
    the unit's own cells and its stratum's. The fits are spread over the
    cluster and reduced to one row per parameter.
    """
    measures = cell_measures(s1, s2, levels)
    size = len(measures)
    if design.calibration is not None:
        replicates, whole = calibrated_jackknife(design, measures)
    else:
        units = unit_vectors(reduced(design, [s1, s2]), measures)
        replicates, whole = jackknife_totals(design, units, size), full_totals(units, size)
    whole = whole.select(F.lit("all").alias("rep"), F.col("total").alias("cells"), F.lit(0.0).alias("factor"))
    parts = design.df.sparkSession.sparkContext.defaultParallelism
    arrays = replicates.unionByName(whole).repartition(parts, "rep")
    fits = fit_flow_model(arrays, levels, model, ["rep", "factor"], zero_flows, tol=tol)
    full = F.col("rep") == "all"
    # Squares about the full-sample value, which comes first: a small table of one row per parameter.
    fits = settle(fits)
    keys = ["param", "i", "j"]
    centre = F.broadcast(fits.where(full).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("v")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    sums = fits.join(centre, same).groupBy(*keys).agg(
        F.max("v").alias("value"),
        F.sum(F.col("factor") * (F.col("value") - F.col("v")) * (F.col("value") - F.col("v"))).alias("var"),
        F.bool_and("converged").alias("converged"),
    )
    return sums.select("param", "i", "j", "value", F.sqrt("var").alias("se"), "converged")


def degrees_of_freedom(model: str, g: int) -> int:
    """(G+1)^2 cells less the parameters of the model."""
    levels = sum(g if axis else 1 for axis in MODELS[model])
    return (g + 1) ** 2 - (g - 1 + g * (g - 1) + levels)


def goodness_of_fit(
    design: SurveyDesign, s1: str, s2: str, levels: list, models: list[str] | None = None, zero_flows: bool = True
) -> DataFrame:
    """Pearson statistic of each model with the first-order Rao-Scott correction.

    The statistic on weighted proportions, times the number of persons, is
    divided by the mean generalised design effect of the cells.
    """
    models = models or list(MODELS)
    g = len(levels)
    measures = cell_measures(s1, s2, levels)
    persons = F.try_divide(F.col("_rows"), F.col(design.weight))  # the weight multiplies it back
    shares = stat_set(reduced(design, [s1, s2]), {**measures, "_all": F.lit(1.0), "_n": persons})
    n = shares.row.select(F.round(shares.est("_n")).alias("n"))
    props = shares.ratios({c: (c, "_all") for c in measures})
    cells = list(measures)
    row = props.row.select(
        F.array(*[props.est(c) for c in cells]).alias("cells"), F.array(*[props.cov(c, c) for c in cells]).alias("v")
    ).join(n, F.lit(True))
    schema = "model string, chi2 double, deff double, chi2_rs double, df int, iterations int, converged boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                p = np.asarray(r["cells"], dtype=float)
                size = float(r["n"])
                present = p > 0
                deff = (np.asarray(r["v"], dtype=float)[present] * size / p[present]).sum() / (present.sum() - 1)
                fit = fit_tables(p.reshape(1, g + 1, g + 1), r["model"], zero_flows)
                want = fit["fitted"].reshape(-1)
                ok = want > 0
                chi2 = size * ((p[ok] - want[ok]) ** 2 / want[ok]).sum()
                df = degrees_of_freedom(r["model"], g)
                yield pd.DataFrame(
                    {
                        "model": [r["model"]],
                        "chi2": [chi2],
                        "deff": [deff],
                        "chi2_rs": [chi2 / deff],
                        "df": [df],
                        "iterations": [int(fit["iterations"][0])],
                        "converged": [bool(fit["converged"][0])],
                    }
                )

    one_per_model = row.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    tests = one_per_model.repartition(len(models), "model").mapInPandas(run, schema)
    tails = {"critical": chi2_point("df"), "p": chi2_above("chi2_rs", "df")}
    return tests.withColumns(tails).select("model", "chi2", "deff", "chi2_rs", "df", "critical", "p", "iterations", "converged")


def exits_to(parameters: DataFrame, state: str, domain: str) -> DataFrame:
    """Transition probabilities into one state, one column per domain."""
    found = parameters.where((F.col("param") == "pij") & (F.col("j") == state))
    return found.groupBy("i").pivot(domain, ["Hombre", "Mujer"]).agg(F.first("value"))
