from pyspark.sql import Window
from pyspark.sql import functions as F

from rotapanel.functions.recode import in_labour_force, unemployed
from rotapanel.operators.weights import annual_weights, quarterly_weights
from rotapanel.sources.microdata import (
    MICRODATA_SCHEMA, contract_violations, derive_microdata, number_within, read_microdata, survey_base, write_microdata,
)


def test_one_year_has_the_known_size_and_rates(spark, sf, tiny):
    assert derive_microdata(spark, tiny, 1997).count() == 219
    year = derive_microdata(spark, sf, 1997)
    assert year.count() == 2279
    known = quarterly_weights(year).where(F.col("trabajo").isNotNull())
    w = F.col("dk_mes")
    rows = known.groupBy("trimestre").agg(
        (F.sum(w * unemployed()) / F.sum(w * in_labour_force())).alias("r")
    ).orderBy("trimestre").collect()
    assert [round(r.r, 6) for r in rows] == [0.519458, 0.513638, 0.507795, 0.486648]
    missing = year.agg(
        F.count_if(F.col("trabajo").isNull()).alias("t"), F.count_if(F.col("pobreza").isNull()).alias("p")
    ).first()
    assert (missing.t, missing.p) == (107, 402)


def test_all_orders_become_persons(spark, sf):
    assert survey_base(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_contract_holds_and_catches_breaches(spark, tiny):
    people = survey_base(spark, tiny)
    assert all(r.broken == 0 for r in contract_violations(people).collect())
    broken = people.unionByName(people.withColumn("mes_trimestre", F.lit("M9")).withColumn("fep", F.lit(1.0)))
    found = {r.rule: r.broken for r in contract_violations(broken).collect()}
    assert found["unknown_period"] == people.count()
    assert found["person_twice_in_quarter"] > 0 and found["household_in_two_months"] > 0
    assert found["household_with_two_weights"] > 0


def test_numbering_in_slices_equals_one_window(spark):
    # One key holds half of the rows.
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 37).alias("k"), (F.col("id") * 7 % 4001).alias("o"), (F.col("id") % 5).alias("m")
    )
    sliced = number_within(rows, ["k"], "o", {"low": F.col("m")}, width=64)
    whole = Window.partitionBy("k")
    plain = rows.select(
        "k", "o", F.row_number().over(whole.orderBy("o")).cast("long").alias("number"), F.min("m").over(whole).alias("low")
    )
    mine = sliced.select("k", "o", F.col("number").cast("long"), "low")
    assert mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0


def test_stored_file_is_pruned_by_quarter(spark, tiny, tmp_path):
    path = write_microdata(derive_microdata(spark, tiny), str(tmp_path / "base"))
    two = read_microdata(spark, path, ["T1", "T2"])
    assert {f.name for f in two.schema} == {f.name for f in MICRODATA_SCHEMA}
    plan = two.select("id_hogar")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [trimestre" in plan and "ReadSchema: struct<id_hogar:bigint>" in plan


def test_accumulated_weights_sum_to_shares(spark, sf):
    people = survey_base(spark, sf)
    month = people.groupBy("trimestre", "mes_trimestre").agg(F.sum("fep").alias("n")).collect()
    year = sum(r.n for r in month)
    want = sum(r.n * r.n / year for r in month)
    assert abs(annual_weights(people).agg(F.sum("dk_anual")).first()[0] - want) < 1e-6 * want
    for r in quarterly_weights(people).groupBy("trimestre").agg(F.sum("dk_mes").alias("s")).collect():
        sizes = [m.n for m in month if m.trimestre == r.trimestre]
        assert abs(r.s - sum(x * x for x in sizes) / sum(sizes)) < 1e-6 * r.s
