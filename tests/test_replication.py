import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators import replication
from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.operators.estimation import rollup_totals, survey_total
from rotapanel.operators.replication import (
    bootstrap_totals, calibrated_jackknife, calibration_vectors, full_totals, half_sample_totals, recalibrated, signed_sums, unit_vectors,
)
from test_moments import people


def test_signed_sums():
    x = np.random.default_rng(1).normal(size=(16, 3))
    signs = np.array([[(-1) ** bin(r & h).count("1") for h in range(16)] for r in range(16)])
    np.testing.assert_allclose(signed_sums(x), signs @ x)


@pytest.mark.parametrize("low", [2, replication.LOW_BITS])
def test_half_samples_in_blocks(spark, monkeypatch, low):
    monkeypatch.setattr(replication, "LOW_BITS", low)
    rng = np.random.default_rng(2)
    data = {h: rng.normal(10, 3, (1 if h == 5 else rng.integers(2, 6), 2)) for h in range(37)}
    rows = [(f"h{h:02d}", 100 * h + i, 1.0, float(a), float(b)) for h, v in data.items() for i, (a, b) in enumerate(v)]
    design = SurveyDesign(spark.createDataFrame(rows, "estrato string, upm long, w double, y double, x double"), "w")
    got = {int(r.rep): (r.cells, r.factor) for r in half_sample_totals(unit_vectors(design, {"y": F.col("y"), "x": F.col("x")}), 2).collect()}
    assert sorted(got) == list(range(64))
    for r in range(64):
        want = np.zeros(2)
        for number, (_, v) in enumerate(sorted(data.items()), 1):
            own = v[[k for k in range(len(v)) if (k + 1) % 2 == bin(r & number).count("1") % 2]] if len(v) > 1 else v
            want += own.sum(0) * len(v) / len(own)
        assert got[r][0] == pytest.approx(want) and got[r][1] == 1 / 64


def test_half_samples_of_many_strata(spark):
    """Strata times replicates would be 6.5e8 rows."""
    rows = spark.range(40_000).select(
        F.format_string("h%05d", F.col("id") % 20_000).alias("estrato"), "id", (F.xxhash64("id") % 100).cast("double").alias("y"), F.lit(1.0).alias("w")
    )
    design = SurveyDesign(rows, "w", psu="id")
    totals = half_sample_totals(unit_vectors(design, {"y": F.col("y")}), 1)
    total = rows.agg(F.sum("y")).first()[0]
    got = totals.agg(F.count("*").alias("n"), F.sum(F.col("factor") * F.pow(F.col("cells")[0] - total, 2)).alias("v")).first()
    assert got.n == 1 << 15 and got.v == pytest.approx(survey_total(design, y=F.col("y")).first()["var"], rel=1e-9)


def refits(pdf, terms, totals, measures, weight="d"):
    """Calibrated totals without each unit, by a loop over replicates."""
    out, factors = [], []
    units = pdf[["estrato", "upm"]].drop_duplicates()
    n = units.groupby("estrato").upm.count()
    for h, u in units.itertuples(index=False):
        scale = np.where(pdf.estrato == h, np.where(pdf.upm == u, 0, n[h] / (n[h] - 1)), 1.0)
        d = pdf[weight].to_numpy() * scale
        pull = np.linalg.lstsq((terms * d[:, None]).T @ terms, totals - d @ terms, rcond=None)[0]
        out.append((d * (1 + terms @ pull)) @ measures)
        factors.append((n[h] - 1) / n[h])
    return np.array(out), np.array(factors)


def calibrated_weights(pdf, terms, totals):
    d = pdf.d.to_numpy()
    return d * (1 + terms @ np.linalg.lstsq((terms * d[:, None]).T @ terms, totals - d @ terms, rcond=None)[0])


@pytest.mark.parametrize("kind", ["margin", "stratum", "sized"])
def test_jackknife_repeats_the_calibration(spark, kind):
    pdf = people(spark, seed=5, rows=400).toPandas()
    y, one = pdf.y.to_numpy(), np.ones(len(pdf))
    strata = np.stack([(pdf.estrato == h).to_numpy() * (y if kind == "sized" else one) for h in sorted(pdf.estrato.unique())], 1)
    terms = np.stack([one, pdf.m.to_numpy(), y], 1) if kind == "margin" else strata
    totals = 1.3 * (pdf.d.to_numpy() @ terms)
    pdf["w"] = calibrated_weights(pdf, terms, totals)
    own = {"margin": MarginCalibration("d", {"one": F.lit(1.0), "m": F.col("m"), "y": F.col("y")}), "stratum": StratumCalibration("d"), "sized": StratumCalibration("d", "y")}
    design = SurveyDesign(spark.createDataFrame(pdf), "w", calibration=own[kind])
    measures = {"k1": F.when(F.col("k") == 1, 1.0), "y2": F.when(F.col("k") == 2, F.col("y"))}
    values = np.stack([(pdf.k == 1).to_numpy() * 1.0, (pdf.k == 2).to_numpy() * y], 1)
    rows, whole = calibrated_jackknife(design, measures)
    want, factors = refits(pdf, terms, totals, values)
    got = sorted((r.factor, *r.cells) for r in rows.collect())
    np.testing.assert_allclose(got, sorted((f, *w) for f, w in zip(factors, want)), rtol=1e-8)
    assert whole.first().total == pytest.approx(pdf.w.to_numpy() @ values)


def test_bootstrap_can_be_calibrated_too(spark):
    df = people(spark, seed=6, rows=400)
    terms = {"one": F.lit(1.0), "m": F.col("m")}
    totals = [float(x) for x in df.agg(F.sum(F.col("w")), F.sum(F.col("w") * F.col("m"))).first()]
    design = SurveyDesign(df, "w", calibration=MarginCalibration("d", terms))
    units, size = calibration_vectors(design, {"one": F.lit(1.0), "y": F.col("y")})
    rows = recalibrated(bootstrap_totals(units, size, 50), 2, totals).collect()
    # The size of the population is a control, so every replicate meets it.
    assert len(rows) == 50 and all(r.cells[0] == pytest.approx(totals[0]) for r in rows) and len({round(r.cells[1], 3) for r in rows}) == 50
    assert full_totals(units, size).first().total[0] != pytest.approx(totals[0])


def test_rollup_of_two_factors(spark):
    df = people(spark, seed=7).withColumn("g", F.when(F.col("g") != "z", F.col("g")))
    for cal in (None, StratumCalibration("d", "y"), MarginCalibration("d", {"one": F.lit(1.0), "y": F.col("y")})):
        design = SurveyDesign(df, "w", calibration=cal)
        rows = {(r.k, r.g): r for r in rollup_totals(design, ["k", "g"], label="all").collect()}
        assert len(rows) == 9 + 3 + 1
        for by, keys in (([], lambda r: ("all", "all")), (["k"], lambda r: (str(r.k), "all")), (["k", "g"], lambda r: (str(r.k), r.g))):
            for r in survey_total(design, by).collect():
                mine = rows[keys(r)]
                assert mine.total == pytest.approx(r.total) and mine.se == pytest.approx(r.se, rel=1e-6, abs=1e-6 * r.total)
        cube = rollup_totals(design, ["k", "g"], [["k", "g"], ["g"], []], label="all").collect()
        assert {r.k for r in cube if r.g == "x"} == {"1", "2", "3", "all"}
