import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.functions.running import quantiles, running_sums


def test_running_sums_per_group(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 11).alias("v"))
    got = running_sums(rows, "o", ["v"], ["g"]).toPandas().sort_values(["g", "o"])
    want = got.groupby("g").v.cumsum()
    assert (got.cum_v == want).all() and len(got) == 5000


def test_quantiles_interpolate(spark):
    # A third of the rows share one value.
    x = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 7919 % 1009) / 3.0)
    rows = spark.range(3001).select(x.alias("x"), (F.col("id") % 2).alias("g"))
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    values = rows.toPandas()
    whole = quantiles(rows, "x", points).first()
    assert whole.n == 3001 and whole["mean"] == pytest.approx(values.x.mean())
    for name, p in points.items():
        assert whole[name] == pytest.approx(np.quantile(values.x, p))
    for r in quantiles(rows, "x", points, ["g"]).collect():
        for name, p in points.items():
            assert r[name] == pytest.approx(np.quantile(values[values.g == r.g].x, p))
