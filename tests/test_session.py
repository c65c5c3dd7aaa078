import os

import pytest
from pyspark.sql import functions as F

from rotapanel.operators.calibration import calibrate
from rotapanel.session import bucketed, drop_table, join_groups, shared_dir


def test_bucketed_tables_join_without_an_exchange(spark):
    rows = spark.range(5_000).select((F.col("id") % 700).alias("k"), "id")
    one_name, one = bucketed(rows, ["k"], 4)
    two_name, two = bucketed(one.groupBy("k").agg(F.sum("id").alias("s")), ["k"], 4, dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = one.join(two, "k")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 5_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    files = spark.sql(f"DESCRIBE EXTENDED {one_name}").where("col_name = 'Location'").first().data_type.removeprefix("file:")
    assert files.startswith(shared_dir(spark).removeprefix("file:")) and os.path.exists(files)
    for name in (one_name, two_name, None):
        drop_table(spark, name)
    assert not os.path.exists(files)


def test_groups_with_null_keys_are_joined(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, x int")
    groups = spark.createDataFrame([("a", 10), (None, 30)], "k string, g int")
    assert sorted((r.x, r.g) for r in join_groups(rows, groups, ["k"]).collect()) == [(1, 10), (2, 10), (3, 30)]
    assert {r.x: r.g for r in join_groups(rows, groups, ["k"], "left").collect()} == {1: 10, 2: 10, 3: 30, 4: None}


def test_calibration_within_periods_of_any_name(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("period"), (F.col("id") % 7 + 1.0).alias("w"), (F.col("id") % 2).alias("m")
    )
    terms = {"all": F.lit(1.0), "m": F.col("m").cast("double")}
    out = calibrate(rows, "w", terms, {"all": 1000.0, "m": 400.0}, within=["period"])
    sums = out.groupBy("period").agg(F.sum("w_cal").alias("n"), F.sum(F.col("w_cal") * F.col("m")).alias("m")).collect()
    assert len(sums) == 3 and all(r.n == pytest.approx(1000) and r.m == pytest.approx(400) for r in sums)
