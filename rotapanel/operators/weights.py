"""Weights for pooled rounds."""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.session import join_small
from rotapanel.sources.microdata import MONTHS, QUARTERS

PERIOD = ["trimestre", "mes_trimestre"]


def month_sums(df: DataFrame, weight: str = "fep") -> DataFrame:
    """Sum of weights per month: at most one row per known period code."""
    return (
        df.where(F.col("trimestre").isin(QUARTERS) & F.col("mes_trimestre").isin(MONTHS))
        .groupBy(*PERIOD)
        .agg(F.sum(weight).alias("num"))
    )


def or_fail(factor: Column, message: str, unmatched: str = "fail") -> Column:
    """A factor that rows need: without it the job ends, or with "keep" the weight is NULL. No row is lost."""
    if unmatched == "keep":
        return factor
    if unmatched != "fail":
        raise ValueError("unmatched is 'fail' or 'keep'")
    return F.coalesce(factor, F.raise_error(F.lit(message)).cast("double"))


def quarter_factors(df: DataFrame, weight: str = "fep") -> DataFrame:
    """Each month's share ``ai`` of the weights of its quarter."""
    sums = month_sums(df, weight)
    return sums.select(
        *PERIOD, "num", F.sum("num").over(Window.partitionBy("trimestre")).alias("den")
    ).withColumn("ai", F.col("num") / F.col("den"))


def year_factors(df: DataFrame, weight: str = "fep") -> DataFrame:
    """Each month's share ``bi`` of the weights of the year.

    The window has no partition, over the twelve month rows only.
    """
    sums = month_sums(df, weight)
    year = Window.partitionBy(F.lit(1))
    return sums.select(*PERIOD, "num", F.sum("num").over(year).alias("den")).withColumn(
        "bi", F.col("num") / F.col("den")
    )


def quarterly_weights(df: DataFrame, weight: str = "fep", name: str = "dk_mes", unmatched: str = "fail") -> DataFrame:
    """Accumulated weight of a quarter: the month's share times the weight.

    The factor table has at most 12 rows (it keeps known period codes only),
    so it is broadcast whatever the size of the microdata.
    """
    factors = quarter_factors(df, weight).select(*PERIOD, "ai")
    joined = df.join(F.broadcast(factors), PERIOD, "left")
    return joined.withColumn(name, F.col(weight) * or_fail(F.col("ai"), "a row has an unknown period code", unmatched))


def annual_weights(df: DataFrame, weight: str = "fep", name: str = "dk_anual", unmatched: str = "fail") -> DataFrame:
    """Accumulated weight of a year; the factor table has at most 12 rows."""
    factors = year_factors(df, weight).select(*PERIOD, "bi")
    joined = df.join(F.broadcast(factors), PERIOD, "left")
    return joined.withColumn(name, F.col(weight) * or_fail(F.col("bi"), "a row has an unknown period code", unmatched))


def pool_rounds(rounds: Iterable[DataFrame], weight: str = "fep", name: str = "w_pool") -> DataFrame:
    """Stack rounds and divide their weights by the number of rounds."""
    rounds = list(rounds)
    stacked = reduce(lambda a, b: a.unionByName(b), rounds)
    return stacked.withColumn(name, F.col(weight) / F.lit(len(rounds)))


def size_shares(df: DataFrame, strata: str = "estrato", within: list[str] | None = None) -> DataFrame:
    """Share of each month in a stratum's sample of the period ``within``.

    ``within`` is ["trimestre"] for quarters and [] for the year.
    """
    within = ["trimestre"] if within is None else within
    counts = df.groupBy(strata, *PERIOD).agg(F.count(F.lit(1)).alias("n_th"))
    total = F.sum("n_th").over(Window.partitionBy(strata, *within))
    return counts.withColumn("delta", F.col("n_th") / total)


def size_normalised_weights(
    df: DataFrame,
    weight: str = "fep",
    strata: str = "estrato",
    within: list[str] | None = None,
    name: str = "dk_norm",
) -> DataFrame:
    """Weight times the month's sample share in its stratum."""
    shares = size_shares(df, strata, within).select(strata, *PERIOD, "delta")
    return join_small(df, shares, [strata, *PERIOD]).withColumn(name, F.col(weight) * F.col("delta"))


def month_index() -> Column:
    """1 … 12 from quarter and month codes."""
    quarter = F.substring("trimestre", 2, 1).cast("int")
    month = F.substring("mes_trimestre", 2, 1).cast("int")
    return (quarter - 1) * 3 + month


def moving_quarters(df: DataFrame, aggregates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sums over every three consecutive months, labelled by the last one.

    ``aggregates`` are expressions to be summed. Months are reduced first;
    only month rows are repeated over the windows they belong to.
    """
    by = by or []
    months = df.groupBy(month_index().alias("mes"), *by).agg(
        *[F.sum(e).alias(n) for n, e in aggregates.items()]
    )
    return (
        months.withColumn("mes_fin", F.explode(F.sequence("mes", F.col("mes") + 2)))
        .where(F.col("mes_fin").between(3, 12))
        .groupBy("mes_fin", *by)
        .agg(*[F.sum(n).alias(n) for n in aggregates])
    )


def mean_weight(df: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weight per respondent by month and domain, expected to be stable over months."""
    keys = [*PERIOD, *(by or [])]
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_obs"), F.sum(weight).alias("n_hat"))
        .withColumn("prop", F.col("n_hat") / F.col("n_obs"))
    )


def coherence(
    df: DataFrame, weight: str, controls: DataFrame, total: str, by: list[str]
) -> DataFrame:
    """Weighted size per domain against its control total."""
    ours = df.groupBy(*by).agg(F.sum(weight).alias("n_hat"))
    theirs = controls.groupBy(*by).agg(F.sum(total).alias("control"))
    joined = ours.join(theirs, by, "full_outer") if by else ours.join(theirs, F.lit(True))  # one row each
    return joined.withColumn("rel_diff", F.try_divide(F.col("n_hat") - F.col("control"), F.col("control")))


def representatives(df: DataFrame) -> DataFrame:
    """One person per household and quarter."""
    return df.where(F.col("id_pers") == 1)
