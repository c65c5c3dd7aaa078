"""Changes between rounds, tests and planning variances."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.distributions import t_point, t_two_sided
from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.estimation import degrees_of_freedom
from rotapanel.operators.statset import StatSet, domain_means, level_measures, stat_set


def contrast(stats: StatSet, coefficients: dict[str, float], name: str = "contrast") -> DataFrame:
    """One linear contrast with its standard error."""
    return stats.combine({name: coefficients}).estimates()


def net_change(stats: StatSet, later: str, earlier: str, name: str = "delta") -> DataFrame:
    """later − earlier, with both variances and the covariance that enter its error."""
    v2, v1, c12 = stats.cov(later, later), stats.cov(earlier, earlier), stats.cov(earlier, later)
    delta = stats.est(later) - stats.est(earlier)
    variance = v2 + v1 - 2 * c12
    return stats.row.select(
        delta.alias(name), v1.alias("var_1"), v2.alias("var_2"), c12.alias("cov_12"), F.sqrt(variance).alias("se")
    )


def design_t_test(design: SurveyDesign, y: Column, levels: dict[str, Column]) -> DataFrame:
    """Difference of two domain means against zero.

    The degrees of freedom are units minus strata, less one for the slope.
    """
    first, second = levels
    change = net_change(domain_means(design, y, levels), second, first).select("delta", "se")
    df = degrees_of_freedom(design).select((F.col("df") - 1).alias("df"))
    both = change.join(F.broadcast(df), F.lit(True)).withColumn("t", F.col("delta") / F.col("se"))  # one row each
    return both.withColumns(
        {"t_crit": t_point("df"), "p": t_two_sided("t", "df")}
    ).withColumn("reject", F.abs("t") > F.col("t_crit"))


def moving_rates(design: SurveyDesign, periods: dict[str, Column], num: Column, den: Column, width: int = 3) -> StatSet:
    """Ratios of sums over each ``width`` neighbouring periods, named by the last one.

    Windows share periods, and periods share units; both show in the covariances, which come from one pass.
    """
    names = list(periods)
    stats = stat_set(design, level_measures(periods, {"y": num, "z": den}))
    windows = {names[e]: names[e - width + 1 : e + 1] for e in range(width - 1, len(names))}
    sums = stats.combine({f"{e}|{m}": {f"{x}|{m}": 1.0 for x in own} for e, own in windows.items() for m in ("y", "z")})
    return sums.ratios({e: (f"{e}|y", f"{e}|z") for e in windows})


def change_variance(v1: Column, v2: Column, t1: Column, t2: Column, r12: Column) -> Column:
    """Variance of a change between two rounds that share ``t1``, ``t2`` of their samples."""
    return v1 + v2 - 2 * F.sqrt(v1) * F.sqrt(v2) * F.sqrt(t1) * F.sqrt(t2) * r12


def covariance_between(v1: Column, v2: Column, t1: Column, t2: Column, r12: Column) -> Column:
    return F.sqrt(v1) * F.sqrt(v2) * F.sqrt(t1) * F.sqrt(t2) * r12


def mean_of_three_variance(v: Column, t: Column, r: Column) -> Column:
    """Variance of the mean of three rounds with common variance, overlap and correlation."""
    return v / 9 * (3 + 6 * t * r)


def weighted_correlation(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted correlation of two columns over linked units, from sums.

    The columns are centred on their means first, in a separate small
    aggregate, so that the sums of squares do not cancel.
    """
    means = df.agg(
        (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mx"),
        (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("my"),
    ).first()
    dx, dy = F.col(x) - F.lit(means.mx), F.col(y) - F.lit(means.my)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(
            F.sum(F.col(w) * dx * dy), F.sqrt(F.sum(F.col(w) * dx * dx)) * F.sqrt(F.sum(F.col(w) * dy * dy))
        ).alias("r12"),
    )
