import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators import moments
from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.operators.moments import domain_covariances, unpacked
from rotapanel.operators.statset import stat_set


def people(spark, seed=1, strata=6, units=9, rows=1_500):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, strata, rows)
    data = [
        (f"h{a}", int(a * 100 + rng.integers(0, units if a else 3 * units)), float(rng.uniform(1, 5)), float(rng.uniform(1, 3)), float(rng.normal(50, 9)),
         int(rng.integers(1, 4)), str(rng.choice(["x", "y", "z"])), float(rng.random() < 0.5)) for a in h
    ]
    return spark.createDataFrame(data, "estrato string, upm long, w double, d double, y double, k int, g string, m double").cache()


def by_hand(pdf, values, weight, residual=None):
    """Covariances of totals; ``residual`` gives each person's residuals."""
    e = values if residual is None else residual
    z = {}
    for (h, u), v in zip(zip(pdf.estrato, pdf.upm), e * pdf[weight].to_numpy()[:, None]):
        z[h, u] = z.get((h, u), 0) + v
    out = np.zeros((e.shape[1],) * 2)
    for h in {a for a, _ in z}:
        x = np.array([v for (a, _), v in z.items() if a == h])
        c = x - x.mean(0)
        out += len(x) / (len(x) - 1) * c.T @ c
    return out


def check(row, total, cov, k):
    np.testing.assert_allclose(row.total, total, rtol=1e-10)
    np.testing.assert_allclose(unpacked(np.array(row.cov), k), cov, rtol=1e-8, atol=1e-8 * np.abs(cov).max())


def measures():
    return {"a": F.lit(1.0), "y": F.col("y"), "k1": F.when(F.col("k") == 1, F.col("y")), "k2": F.when(F.col("k") == 2, 1.0)}


def measured(pdf, inside):
    y = pdf.y.to_numpy()
    return np.stack([np.ones(len(y)), y, np.where(pdf.k == 1, y, 0), np.where(pdf.k == 2, 1.0, 0)], 1) * inside[:, None]


@pytest.mark.parametrize("split", [moments.SPLIT, 4])
@pytest.mark.parametrize("kind", ["plain", "stratum", "sized", "margin"])
def test_domains_equal_residuals_by_hand(spark, monkeypatch, split, kind):
    monkeypatch.setattr(moments, "SPLIT", split)
    df = people(spark)
    terms = {"one": F.lit(1.0), "m": F.col("m"), "y": F.col("y")}
    cal = {"plain": None, "stratum": StratumCalibration("d"), "sized": StratumCalibration("d", "y"), "margin": MarginCalibration("d", terms)}[kind]
    design = SurveyDesign(df, "w", calibration=cal).where(F.col("g") != "z")
    pdf = df.toPandas()
    for by in ([], ["k"], ["k", "g"]):
        rows = domain_covariances(design, measures(), by).collect()
        groups = pdf[pdf.g != "z"][by].drop_duplicates() if by else [()]
        assert len(rows) == len(groups)
        for r in rows:
            inside = (pdf.g != "z").to_numpy() & np.all([pdf[c] == r[c] for c in by] or [np.ones(len(pdf), bool)], axis=0)
            v = measured(pdf, inside)
            residual = v.copy()
            if kind in ("stratum", "sized"):
                z = pdf.y.to_numpy() if kind == "sized" else np.ones(len(pdf))
                for h in pdf.estrato.unique():
                    own = (pdf.estrato == h).to_numpy()
                    d = pdf.d.to_numpy()[own]
                    b = (v[own] * (d * z[own])[:, None]).sum(0) / (d * z[own] ** 2).sum()
                    residual[own] -= np.outer(z[own], b)
            elif kind == "margin":
                z, d = np.stack([np.ones(len(pdf)), pdf.m, pdf.y], 1), pdf.d.to_numpy()
                residual -= z @ np.linalg.solve((z * d[:, None]).T @ z, (z * d[:, None]).T @ v)
            check(r, (v * pdf.w.to_numpy()[:, None]).sum(0), by_hand(pdf, v, "w", residual), 4)


def test_large_totals_keep_their_digits(spark):
    rows = [(f"h{h}", 10 * h + i, 1.0, 1e12 + 0.25 * i) for h in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "estrato string, upm long, w double, y double")
    row = domain_covariances(SurveyDesign(df, "w"), {"y": F.col("y")}).first()
    assert row.total[0] == pytest.approx(20e12) and row["cov"][0] == pytest.approx(5 * 4 / 3 * 0.25**2 * 5, rel=1e-9)


def test_hundreds_of_statistics(spark):
    df = people(spark, seed=2)
    names = {f"s{j}": F.when(F.col("k") == 1 + j % 3, F.col("y") * (j + 1) / 100) for j in range(500)}
    stats = stat_set(SurveyDesign(df, "w"), names)
    rows = {r.stat: r for r in stats.estimates().collect()}
    assert len(rows) == 500 and rows["s3"].se == pytest.approx(4 * rows["s0"].se) and rows["s499"].estimate == pytest.approx(250 * rows["s1"].estimate)
    pairs = {(r.stat_a, r.stat_b): r["cov"] for r in stats.vcov(["s0", "s3", "s7"]).collect()}
    assert len(pairs) == 9 and pairs["s3", "s0"] == pairs["s0", "s3"] == pytest.approx(rows["s0"].se * rows["s3"].se)


def test_functions_of_no_spread_have_no_error(spark):
    df = people(spark, seed=3)
    stats = stat_set(SurveyDesign(df, "w"), {"a": F.col("y"), "b": F.col("y") * 3, "none": F.lit(None)})
    same = stats.ratios({"r": ("b", "a")}).estimates().first()
    assert same.estimate == pytest.approx(3) and same.se == pytest.approx(0, abs=1e-6)
    assert stats.combine({"d": {"b": 1, "a": -3}}).estimates().first().se == pytest.approx(0, abs=0.01)
    assert stats.ratios({"r": ("a", "none")}).estimates().first().estimate is None


def test_domains_of_a_stat_set(spark):
    df = people(spark, seed=4)
    rows = stat_set(SurveyDesign(df, "w"), {"y": F.col("y"), "n": F.lit(1.0)}, ["g"]).ratios({"mean": ("y", "n")}).estimates().collect()
    assert {r.g for r in rows} == {"x", "y", "z"} and all(r.se > 0 for r in rows)


def test_no_rows(spark):
    assert domain_covariances(SurveyDesign(people(spark).where("k = 9"), "w"), measures(), ["g"]).count() == 0
