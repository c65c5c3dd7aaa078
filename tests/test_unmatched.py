"""Rows without a control, a period or a representative are never lost."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.calibration import calibrate, integrative, poststratify, unmatched_cells
from rotapanel.operators.flows import flow_table
from rotapanel.operators.overlap import state_spells
from rotapanel.operators.weights import annual_weights, quarterly_weights
from rotapanel.plans.quarterly import attach_household_weight


@pytest.fixture
def sample(spark):
    return spark.createDataFrame([("a", 2.0, 1), ("a", 3.0, 2), ("b", 5.0, 1)], "estrato string, w double, n int")


@pytest.fixture
def goals(spark):
    return spark.createDataFrame([("a", 10.0), ("c", 7.0)], "estrato string, total double")


def test_stratum_without_control(sample, goals):
    for run in (
        lambda **k: poststratify(sample, "w", goals, "total", ["estrato"], **k),
        lambda **k: integrative(sample, "w", "n", goals, "total", ["estrato"], **k),
    ):
        with pytest.raises(Exception, match="no control total"):
            run().collect()
        rows = run(unmatched="keep").collect()
        assert len(rows) == 3 and [r.w_cal for r in rows if r.estrato == "b"] == [None]
    both = {(r.estrato, r.side, r.n) for r in unmatched_cells(sample, goals, ["estrato"]).collect()}
    assert both == {("b", "sample", 1), ("c", "control", 1)}


def test_unknown_period(spark):
    rows = [("T1", "M1", 2.0), ("T1", "M2", 1.0), ("T5", "M1", 4.0)]
    df = spark.createDataFrame(rows, "trimestre string, mes_trimestre string, fep double")
    for run, name in ((quarterly_weights, "dk_mes"), (annual_weights, "dk_anual")):
        with pytest.raises(Exception, match="unknown period"):
            run(df).collect()
        kept = {r.trimestre: r[name] for r in run(df, unmatched="keep").collect()}
        assert kept["T5"] is None and len(kept) == 2


def test_household_without_representative(spark):
    people = spark.createDataFrame([("T1", "M1", 1, 1), ("T1", "M1", 1, 2)], "trimestre string, mes_trimestre string, upm long, id_hogar long")
    homes = people.where("id_hogar = 1").withColumn("w", F.lit(3.0))
    with pytest.raises(Exception, match="no representative"):
        attach_household_weight(people, homes, "w").collect()
    assert [r.w for r in attach_household_weight(people, homes, "w", "keep").orderBy("id_hogar").collect()] == [3.0, None]


def test_redundant_and_contradicting_terms(spark):
    df = spark.createDataFrame([("1", "H"), ("1", "M"), ("2", "H"), ("2", "M")] * 3, "area string, sexo string").withColumn("d", F.lit(1.0))
    terms = {f"{c}{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, v in (("area", "1"), ("area", "2"), ("sexo", "H"), ("sexo", "M"))}
    out = calibrate(df, "d", terms, {"area1": 60.0, "area2": 40.0, "sexoH": 50.0, "sexoM": 50.0})
    got = {r.area: r.s for r in out.groupBy("area").agg(F.sum("w_cal").alias("s")).collect()}
    assert np.isclose(got["1"], 60) and np.isclose(got["2"], 40)
    with pytest.raises(ValueError, match="can't be met"):
        calibrate(df, "d", terms, {"area1": 60.0, "area2": 40.0, "sexoH": 50.0, "sexoM": 90.0})
    with pytest.raises(ValueError, match="zzz"):
        calibrate(df, "d", {**terms, "zzz": F.lit(0.0)}, {"area1": 60.0, "area2": 40.0, "sexoH": 50.0, "sexoM": 50.0, "zzz": 3.0})


def test_calibration_per_period(spark):
    df = spark.createDataFrame([(q, a, 1.0 + k) for q in ("T1", "T2", None) for k, a in enumerate("1122")], "q string, area string, d double")
    terms = {f"area{v}": F.when(F.col("area") == v, 1.0).otherwise(0.0) for v in "12"}
    out = calibrate(df, "d", terms, {"area1": 60.0, "area2": 40.0}, within=["q"])
    sums = out.groupBy("q", "area").agg(F.sum("w_cal").alias("s")).collect()
    assert out.columns == [*df.columns, "w_cal"] and len(sums) == 6
    assert all(np.isclose(r.s, 60.0 if r.area == "1" else 40.0) for r in sums)


def test_flow_table_has_every_state(spark):
    cells = spark.createDataFrame([(1, 1, 5), (2, None, 7), (None, 3, 2), (None, None, 1)], "state_1 int, state_2 int, n long")
    rows = {r.estado: tuple(r)[1:] for r in flow_table(cells, "n", [1, 2, 3]).collect()}
    assert rows == {"1": (5, 0, 0, 0), "2": (0, 0, 0, 7), "3": (0, 0, 0, 0), "Complemento columna": (0, 0, 2, 1)}


def test_spells_end_at_gaps(spark):
    df = spark.createDataFrame([(1, "T1", "x"), (1, "T3", "x"), (1, "T4", "x"), (2, "T1", "x"), (2, "T2", "y")], "u int, trimestre string, s string")
    spells = sorted((r.u, r.estado, r.desde, r.hasta, r.duracion) for r in state_spells(df, ["u"], "s").collect())
    assert spells == [(1, "x", "T1", "T1", 1), (1, "x", "T3", "T4", 2), (2, "x", "T1", "T1", 1), (2, "y", "T2", "T2", 1)]
