"""Totals, means, ratios and their design variances.

Rows are reduced to one row per primary sampling unit and domain, those to
moments per stratum and domain, and those to estimates. The microdata is
scanned and shuffled once, after partial sums on the map side.
"""
from __future__ import annotations

from dataclasses import replace
from itertools import combinations_with_replacement as pairs_of

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.operators.calibration import solved
from rotapanel.operators.design import MarginCalibration, SurveyDesign
from rotapanel.operators.moments import domain_covariances
from rotapanel.session import settle




def unit_sums(design: SurveyDesign, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sums per (stratum, unit, domain); rows outside the domain form their own group."""
    inside = design.inside
    keys = [F.when(inside, F.col(c)).alias(c) for c in by]
    return design.df.groupBy(
        F.col(design.strata).alias("h"), F.col(design.psu).alias("i"), inside.alias("inside"), *keys
    ).agg(*[F.sum(e).alias(n) for n, e in measures.items()])


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(pairs_of(names, 2))


def _with_unit_totals(units: DataFrame, by: list[str], over_unit: list[str]) -> DataFrame:
    """Add to each row its unit's totals, and flag one row per unit."""
    unit = Window.partitionBy("h", "i")
    first = unit.orderBy("inside", *by)
    return units.withColumns(
        {
            "lead": (F.row_number().over(first) == 1).cast("int"),
            **{f"{m}_all": F.sum(m).over(unit) for m in over_unit},
        }
    )


def domain_moments(
    design: SurveyDesign, by: list[str], measures: dict[str, Column]
) -> tuple[DataFrame, list[str]]:
    """Totals ``s_m`` and covariances ``v_m_k`` of weighted sums per domain.

    With weights calibrated per stratum the covariances are those of the
    calibration residuals.
    """
    cal = design.calibration
    if isinstance(cal, MarginCalibration):
        return _margin_moments(design, by, measures)
    names = list(measures)
    w = F.col(design.weight)
    sums = {n: w * e for n, e in measures.items()}
    if cal is not None:
        z = F.lit(1.0) if cal.size is None else F.col(cal.size)
        base = F.col(cal.base)
        sums |= {"cz": w * z, "czz": base * z * z}
        sums |= {f"b_{n}": base * z * e for n, e in measures.items()}
    units = unit_sums(design, by, sums)
    over_unit = [] if cal is None else ["cz", "czz"]
    marked = _with_unit_totals(units, by, over_unit)

    stratum_aggs = [F.sum("lead").alias("leads")]
    stratum_aggs += [F.sum(n).alias(f"s_{n}") for n in names]
    stratum_aggs += [F.sum(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for a, b in _pairs(names)]
    if cal is not None:
        stratum_aggs += [F.sum(f"b_{n}").alias(f"b_{n}") for n in names]
        stratum_aggs += [F.sum(F.col(n) * F.col("cz_all")).alias(f"mz_{n}") for n in names]
        lead = F.col("lead")
        stratum_aggs += [
            F.sum(lead * F.col("cz_all")).alias("z1"),
            F.sum(lead * F.col("cz_all") * F.col("cz_all")).alias("z2"),
            F.sum(lead * F.col("czz_all")).alias("zz"),
        ]
    strata = marked.groupBy("h", "inside", *by).agg(*stratum_aggs)
    stratum = Window.partitionBy("h")
    strata = strata.withColumn("n", F.sum("leads").over(stratum))
    if cal is not None:
        strata = strata.withColumns({c: F.sum(c).over(stratum) for c in ("z1", "z2", "zz")})
        strata = strata.withColumns({f"b_{n}": F.try_divide(F.col(f"b_{n}"), F.col("zz")) for n in names})
    strata = strata.where("inside")

    n = F.col("n")
    scale = design.lonely_factor(n, n / (n - 1))
    covariances = []
    for a, b in _pairs(names):
        second = F.col(f"m_{a}_{b}")
        sa, sb = F.col(f"s_{a}"), F.col(f"s_{b}")
        if cal is not None:
            ba, bb = F.col(f"b_{a}"), F.col(f"b_{b}")
            second = second - bb * F.col(f"mz_{a}") - ba * F.col(f"mz_{b}") + ba * bb * F.col("z2")
            sa, sb = sa - ba * F.col("z1"), sb - bb * F.col("z1")
        covariances.append(F.sum(scale * (second - sa * sb / n)).alias(f"v_{a}_{b}"))
    out = strata.groupBy(*by).agg(*[F.sum(f"s_{x}").alias(f"s_{x}") for x in names], *covariances)
    return out, names


def _margin_moments(
    design: SurveyDesign, by: list[str], measures: dict[str, Column]
) -> tuple[DataFrame, list[str]]:
    """As :func:`domain_moments`, for weights calibrated on margins.

    A domain's measure is regressed on the terms over the whole sample: its
    slopes are the inverse of the terms' products (one small matrix) times the
    domain's own products with the terms. The residual variance is then a quadratic form in
    the slopes, whose parts are sums over strata; the part of the terms alone is the same for all domains.
    """
    cal, names, w = design.calibration, list(measures), F.col(design.weight)
    base, z = F.col(cal.base), [e.cast("double") for e in cal.terms.values()]
    at = range(len(z))
    rows = design.df.withColumns({f"_z{j}": z[j] for j in at})
    products = rows.agg(*[F.sum(base * F.col(f"_z{j}") * F.col(f"_z{k}")).alias(f"g{j}_{k}") for j, k in pairs_of(at, 2)]).first()
    gram = np.zeros((len(z), len(z)))
    for j, k in pairs_of(at, 2):
        gram[j, k] = gram[k, j] = products[f"g{j}_{k}"]
    inverse = solved(gram, np.eye(len(z)) if np.linalg.matrix_rank(gram) == len(z) else gram @ np.linalg.pinv(gram), list(cal.terms))
    sums = {n: w * e for n, e in measures.items()} | {f"z{j}": w * F.col(f"_z{j}") for j in at}
    sums |= {f"b_{n}_{j}": base * F.col(f"_z{j}") * e for n, e in measures.items() for j in at}
    marked = _with_unit_totals(unit_sums(replace(design, df=rows), by, sums), by, [f"z{j}" for j in at])
    lead = F.col("lead")
    aggs = [F.sum("lead").alias("leads")]
    aggs += [F.sum(n).alias(f"s_{n}") for n in names] + [F.sum(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for a, b in _pairs(names)]
    aggs += [F.sum(F.col(n) * F.col(f"z{j}_all")).alias(f"mz_{n}_{j}") for n in names for j in at]
    aggs += [F.sum(f"b_{n}_{j}").alias(f"b_{n}_{j}") for n in names for j in at]
    aggs += [F.sum(lead * F.col(f"z{j}_all")).alias(f"z1_{j}") for j in at]
    aggs += [F.sum(lead * F.col(f"z{j}_all") * F.col(f"z{k}_all")).alias(f"z2_{j}_{k}") for j, k in pairs_of(at, 2)]
    stratum = Window.partitionBy("h")
    strata = marked.groupBy("h", "inside", *by).agg(*aggs)
    whole = ["leads", *[f"z1_{j}" for j in at], *[f"z2_{j}_{k}" for j, k in pairs_of(at, 2)]]
    strata = settle(strata.withColumns({c: F.sum(c).over(stratum) for c in whole}))
    n = F.col("leads")
    scale = design.lonely_factor(n, n / (n - 1))
    # Spread of the terms' unit totals, over all strata.
    each = strata.dropDuplicates(["h"]).agg(
        *[F.sum(scale * (F.col(f"z2_{j}_{k}") - F.col(f"z1_{j}") * F.col(f"z1_{k}") / n)).alias(f"q{j}_{k}") for j, k in pairs_of(at, 2)]
    ).first()
    spread = {(j, k): float(each[f"q{min(j, k)}_{max(j, k)}"]) for j in at for k in at}
    domains = strata.where("inside").groupBy(*by).agg(
        *[F.sum(f"s_{a}").alias(f"s_{a}") for a in names],
        *[F.sum(f"b_{a}_{j}").alias(f"b_{a}_{j}") for a in names for j in at],
        *[F.sum(scale * (F.col(f"m_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n)).alias(f"q_{a}_{b}") for a, b in _pairs(names)],
        *[F.sum(scale * (F.col(f"mz_{a}_{j}") - F.col(f"s_{a}") * F.col(f"z1_{j}") / n)).alias(f"r_{a}_{j}") for a in names for j in at],
    )
    slope = {(a, j): sum(F.lit(float(inverse[j, k])) * F.col(f"b_{a}_{k}") for k in at) for a in names for j in at}
    covariances = []
    for a, b in _pairs(names):
        out = F.col(f"q_{a}_{b}")
        for j in at:
            out = out - slope[b, j] * F.col(f"r_{a}_{j}") - slope[a, j] * F.col(f"r_{b}_{j}")
            for k in at:
                out = out + slope[a, j] * slope[b, k] * F.lit(spread[j, k])
        covariances.append(out.alias(f"v_{a}_{b}"))
    return domains.select(*by, *[f"s_{a}" for a in names], *covariances), names


def _result(moments: DataFrame, by: list[str], estimate: Column, variance: Column, name: str) -> DataFrame:
    return (
        moments.select(*by, estimate.alias(name), F.greatest(variance, F.lit(0.0)).alias("var"))
        .withColumn("se", F.sqrt("var"))
        .withColumn("cv", F.try_divide(F.col("se"), F.col(name)))
    )


def survey_total(
    design: SurveyDesign, by: list[str] | None = None, y: Column | None = None, name: str = "total"
) -> DataFrame:
    """Weighted total per domain with variance, standard error and cv."""
    by = by or []
    m, _ = domain_moments(design, by, {"y": F.lit(1.0) if y is None else y.cast("double")})
    return _result(m, by, F.col("s_y"), F.col("v_y_y"), name)


def survey_ratio(
    design: SurveyDesign, num: Column, den: Column, by: list[str] | None = None, name: str = "ratio"
) -> DataFrame:
    """Ratio of two weighted totals per domain."""
    by = by or []
    m, _ = domain_moments(design, by, {"y": num.cast("double"), "x": den.cast("double")})
    theta = F.try_divide(F.col("s_y"), F.col("s_x"))
    spread = F.col("v_y_y") - 2 * theta * F.col("v_y_x") + theta * theta * F.col("v_x_x")
    return _result(m, by, theta, F.try_divide(spread, F.col("s_x") * F.col("s_x")), name)


def survey_mean(design: SurveyDesign, y: Column, by: list[str] | None = None, name: str = "mean") -> DataFrame:
    """Weighted mean of the rows where ``y`` is known."""
    known = F.when(y.isNotNull(), 1.0).otherwise(0.0)
    return survey_ratio(design, F.coalesce(y.cast("double"), F.lit(0.0)), known, by, name)


def sum_over_months(monthly: DataFrame, by: list[str] | None = None, total: str = "total") -> DataFrame:
    """Quarterly total and standard error from independent monthly totals."""
    return monthly.groupBy(*(by or [])).agg(
        F.sum(total).alias("total_trim"), F.sqrt(F.sum("var")).alias("se_trim")
    )


def with_national(design: SurveyDesign, by: str, label: str = "Nacional", name: str = "total") -> DataFrame:
    """Totals per domain and for the whole population in one rollup table.

    Each row counts once for its domain and once for the label, so both
    levels come out of one pass over the units.
    """
    levels = F.explode(F.array(F.col(by).cast("string"), F.lit(label)))
    inside = design.inside
    w = F.col(design.weight)
    # Reduce before doubling: the copies are made of unit rows, not of persons.
    cal = design.calibration
    if cal is not None and (isinstance(cal, MarginCalibration) or cal.size is not None):
        own = survey_total(design, [by], name=name).withColumn(by, F.col(by).cast("string"))
        return own.unionByName(survey_total(design, name=name).withColumn(by, F.lit(label)))
    sums = {"w": F.sum(F.when(inside, w).otherwise(0.0)), "wall": F.sum(w)}
    sums["b"] = F.sum(F.when(inside, F.col(cal.base if cal else design.weight)).otherwise(0.0))
    sums["ball"] = F.sum(F.col(cal.base if cal else design.weight))
    units = design.df.groupBy(design.strata, design.psu, by).agg(*[e.alias(n) for n, e in sums.items()])
    doubled = units.withColumn("_level", levels)
    unit = Window.partitionBy(design.strata, design.psu)
    per_unit = doubled.groupBy(design.strata, design.psu, "_level").agg(
        *[F.sum(c).alias(c) for c in ("w", "wall", "b", "ball")]
    )
    national = F.col("_level") == label
    per_unit = per_unit.withColumns(
        {
            "z": F.sum(F.when(national, F.col("wall")).otherwise(0.0)).over(unit),
            "lead": national.cast("int"),
        }
    )
    lead = F.col("lead")
    strata = per_unit.groupBy(design.strata, "_level").agg(
        F.sum("lead").alias("leads"),
        F.sum("w").alias("s"),
        F.sum(F.col("w") * F.col("w")).alias("m"),
        F.sum(F.col("w") * F.col("z")).alias("mz"),
        F.sum("b").alias("b"),
        F.sum(lead * F.col("z")).alias("z1"),
        F.sum(lead * F.col("z") * F.col("z")).alias("z2"),
        F.sum(lead * F.col("ball")).alias("zz"),
    )
    stratum = Window.partitionBy(design.strata)
    strata = strata.withColumns(
        {"n": F.sum("leads").over(stratum)} | {c: F.sum(c).over(stratum) for c in ("z1", "z2", "zz")}
    )
    slope = F.try_divide(F.col("b"), F.col("zz")) if cal is not None else F.lit(0.0)
    n = F.col("n")
    second = F.col("m") - 2 * slope * F.col("mz") + slope * slope * F.col("z2")
    first = F.col("s") - slope * F.col("z1")
    variance = F.sum(design.lonely_factor(n, n / (n - 1)) * (second - first * first / n))
    out = strata.groupBy(F.col("_level").alias(by)).agg(F.sum("s").alias("s"), variance.alias("v"))
    return _result(out, [by], F.col("s"), F.col("v"), name)


def rollup_totals(
    design: SurveyDesign, by: list[str], sets: list[list[str]] | None = None, y: Column | None = None, label: str = "Nacional", name: str = "total"
) -> DataFrame:
    """Totals with errors of several factors at all levels of a rollup, or of the grouping ``sets`` given.

    Persons are read once; every level comes from the same rows of units and cells, whatever the weights are
    calibrated to. A factor that a level leaves out shows ``label``; a NULL of the data stays NULL.
    """
    sets = [by[:n] for n in range(len(by), -1, -1)] if sets is None else sets
    stats = domain_covariances(design, {name: F.lit(1.0) if y is None else y}, by, sets)
    inside = F.lit([sum(1 << k for k, c in enumerate(by) if c in own) for own in sets])
    used = F.get(inside, F.col("set"))
    factors = [F.when(used.bitwiseAND(1 << k) != 0, F.col(c).cast("string")).otherwise(F.lit(label)).alias(c) for k, c in enumerate(by)]
    total, variance = F.col("total")[0], F.col("cov")[0]
    out = stats.select(*factors, total.alias("_total"), variance.alias("var")).withColumnRenamed("_total", name)
    return out.withColumn("se", F.sqrt("var")).withColumn("cv", F.try_divide(F.col("se"), F.col(name)))


def degrees_of_freedom(design: SurveyDesign) -> DataFrame:
    """Units minus strata, for the design and for its domain.

    A stratum counts for the domain if it has at least one row of it.
    """
    units = unit_sums(design, [], {"n": F.lit(1.0)}).groupBy("h", "i").agg(
        F.max(F.col("inside").cast("int")).alias("touched")
    )
    strata = units.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("touched").alias("v"))
    return strata.agg(
        F.sum("n").alias("n_psu"),
        F.count(F.lit(1)).alias("n_strata"),
        F.sum(F.col("n") - 1).alias("df"),
        F.sum(F.col("v") * (F.col("n") - 1)).alias("df_domain"),
    )
