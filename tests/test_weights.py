import pytest
from pyspark.sql import functions as F

from rotapanel.operators.weights import month_index, moving_quarters, pool_rounds, size_normalised_weights, size_shares
from rotapanel.sources.microdata import survey_base


def test_shares_of_unequal_months(spark):
    # Dwellings of two panels per month.
    sizes = {"M1": 5000 + 5500, "M2": 4500 + 5100, "M3": 2500 + 3000}
    rows = None
    for m, n in sizes.items():
        part = spark.range(n).select(F.lit("T1").alias("trimestre"), F.lit(m).alias("mes_trimestre"), F.lit("0_1").alias("estrato"))
        rows = part if rows is None else rows.unionByName(part)
    got = {r.mes_trimestre: r.delta for r in size_shares(rows).collect()}
    assert got == {m: n / 25600 for m, n in sizes.items()}


@pytest.mark.parametrize("within", [["trimestre"], []])
def test_normalised_weights_are_convex(spark, sf, within):
    people = survey_base(spark, sf)
    shares = size_shares(people, within=within)
    sums = shares.groupBy("estrato", *within).agg(F.sum("delta").alias("s"), F.min("delta").alias("low")).collect()
    assert all(abs(r.s - 1) < 1e-12 and r.low > 0 for r in sums)
    keys = ["estrato", "trimestre", "mes_trimestre"]
    got = size_normalised_weights(people, within=within).groupBy(*keys).agg(
        F.sum("dk_norm").alias("a"), (F.max("delta") * F.sum("fep")).alias("b")
    )
    assert all(abs(r.a - r.b) < 1e-6 * r.b for r in got.collect())


def test_moving_quarter_is_a_rolling_sum(spark, sf):
    people = survey_base(spark, sf)
    by_month = {r.m: r.w for r in people.groupBy(month_index().alias("m")).agg(F.sum("fep").alias("w")).collect()}
    got = {r.mes_fin: r.w for r in moving_quarters(people, {"w": F.col("fep")}).collect()}
    assert sorted(got) == list(range(3, 13))
    assert all(abs(got[m] - sum(by_month[k] for k in (m - 2, m - 1, m))) < 1e-6 for m in got)


def test_pooling_divides_by_rounds(spark, tiny):
    people = survey_base(spark, tiny)
    total = people.agg(F.sum("fep")).first()[0]
    rounds = [people.where(F.col("trimestre") == q) for q in ("T1", "T2", "T3", "T4")]
    assert pool_rounds(rounds).agg(F.sum("w_pool")).first()[0] == pytest.approx(total / 4)
