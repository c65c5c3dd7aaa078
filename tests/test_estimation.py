"""Variances against explicit loops over sampling units."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.calibration import calibrate, poststratify
from rotapanel.operators.contrasts import change_variance, contrast, mean_of_three_variance, net_change
from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.operators.estimation import (
    degrees_of_freedom, survey_mean, survey_ratio, survey_total, with_national,
)
from rotapanel.operators.statset import domain_means, joint_proportions, level_measures, stat_set
from rotapanel.sources.microdata import survey_base


def design_variance(pdf, u, strata="estrato", psu="upm"):
    """Variance of sum(u) with units drawn with replacement in their strata."""
    total = 0.0
    for _, rows in pdf.assign(u=u).groupby(strata):
        z = rows.groupby(psu)["u"].sum().to_numpy()
        total += len(z) / (len(z) - 1) * ((z - z.mean()) ** 2).sum()
    return total


@pytest.fixture(scope="module")
def people(spark, sf):
    return survey_base(spark, sf)


@pytest.fixture(scope="module")
def pdf(people):
    return people.toPandas()


def test_totals_in_a_domain_keep_all_units(people, pdf):
    got = {r.trimestre: r for r in survey_total(
        SurveyDesign(people, "fep").where((F.col("dam") == "2") & (F.col("sexo") == "Mujer")), ["trimestre"]
    ).collect()}
    for q, r in got.items():
        inside = (pdf.trimestre == q) & (pdf.dam == "2") & (pdf.sexo == "Mujer")
        assert r.total == pytest.approx((pdf.fep * inside).sum())
        assert r["var"] == pytest.approx(design_variance(pdf, pdf.fep * inside), rel=1e-9)
        assert r.cv == pytest.approx(r.se / r.total)


def test_missing_state_is_a_domain(people, pdf):
    got = {r.trabajo: r for r in survey_total(SurveyDesign(people, "fep"), ["trabajo"]).collect()}
    inside = pdf.trabajo.isna()
    assert got[None].total == pytest.approx((pdf.fep * inside).sum())
    assert got[None]["var"] == pytest.approx(design_variance(pdf, pdf.fep * inside), rel=1e-9)


def test_means_and_ratios(people, pdf):
    for r in survey_mean(SurveyDesign(people, "fep"), F.col("ingreso"), ["sexo"]).collect():
        inside = (pdf.sexo == r.sexo).to_numpy()
        n = (pdf.fep * inside).sum()
        mean = (pdf.fep * pdf.ingreso * inside).sum() / n
        assert r["mean"] == pytest.approx(mean)
        assert r["var"] == pytest.approx(design_variance(pdf, pdf.fep * inside * (pdf.ingreso - mean) / n), rel=1e-8)
    y = (pdf.trabajo == "Desocupado").to_numpy() * 1.0
    z = y + (pdf.trabajo == "Ocupado").to_numpy()
    theta = (pdf.fep * y).sum() / (pdf.fep * z).sum()
    want = design_variance(pdf, pdf.fep * (y - theta * z) / (pdf.fep * z).sum())
    num = F.when(F.col("trabajo") == "Desocupado", 1).otherwise(0)
    den = F.when(F.col("trabajo").isin("Desocupado", "Ocupado"), 1).otherwise(0)
    got = survey_ratio(SurveyDesign(people, "fep"), num, den).first()
    assert got.ratio == pytest.approx(theta) and got["var"] == pytest.approx(want, rel=1e-8)


def test_mean_leaves_out_missing_values(spark, people, pdf):
    some = people.withColumn("x", F.when(F.col("id_hogar") % 3 != 0, F.col("ingreso")))
    keep = (pdf.id_hogar % 3 != 0).to_numpy()
    n = (pdf.fep * keep).sum()
    mean = (pdf.fep * pdf.ingreso * keep).sum() / n
    got = survey_mean(SurveyDesign(some, "fep"), F.col("x")).first()
    assert got["mean"] == pytest.approx(mean)
    assert got["var"] == pytest.approx(design_variance(pdf, pdf.fep * keep * (pdf.ingreso - mean) / n), rel=1e-8)


def test_covariances_equal_dense_products(people, pdf):
    quarters = {q: F.col("trimestre") == q for q in ("T1", "T2", "T3")}
    stats = domain_means(SurveyDesign(people, "fep"), F.col("ingreso"), quarters)
    u = {}
    for q in quarters:
        inside = (pdf.trimestre == q).to_numpy()
        n = (pdf.fep * inside).sum()
        mean = (pdf.fep * pdf.ingreso * inside).sum() / n
        u[q] = (pdf.fep * inside * (pdf.ingreso - mean) / n).to_numpy()
    got = {(r.stat_a, r.stat_b): r["cov"] for r in stats.vcov().collect()}
    for a in quarters:
        for b in quarters:
            both = design_variance(pdf, u[a] + u[b]) - design_variance(pdf, u[a]) - design_variance(pdf, u[b])
            want = design_variance(pdf, u[a]) if a == b else both / 2
            assert got[(a, b)] == pytest.approx(want, rel=1e-6, abs=1e-6)
    change = net_change(stats, "T2", "T1").first()
    assert change.se**2 == pytest.approx(design_variance(pdf, u["T2"] - u["T1"]), rel=1e-8)
    three = contrast(stats, dict.fromkeys(quarters, 1 / 3)).first()
    assert three.se**2 == pytest.approx(design_variance(pdf, sum(u.values()) / 3), rel=1e-8)


def test_joint_proportions_sum_to_one(people):
    cells = {f"{q}.{s}": (F.col("trimestre") == q) & (F.col("sexo") == s) for q in ("T1", "T2", "T3", "T4") for s in ("Hombre", "Mujer")}
    stats = joint_proportions(SurveyDesign(people, "fep"), cells)
    assert sum(r.estimate for r in stats.estimates().collect()) == pytest.approx(1)
    # Shares that sum to one have no variance in total.
    block = stats.block(stats.names).first()
    assert abs(block.var_total) < 1e-12 < block.var_diag
    assert block.var_total == pytest.approx(block.var_diag + block.var_cov, abs=1e-15)


def test_residual_variance_by_stratum_both_ways(spark, people, pdf):
    rng = dict(pdf.groupby("estrato").fep.sum() * 1.3)
    controls = spark.createDataFrame([(k, float(v)) for k, v in rng.items()], "estrato string, total double")
    weighted = poststratify(people, "fep", controls, "total", ["estrato"])
    design = SurveyDesign(weighted, "w_cal", calibration=StratumCalibration("fep"))
    y = (pdf.sexo == "Mujer") & (pdf.trimestre == "T2")
    w = pdf.fep * 1.3
    mean = (pdf.fep * y).groupby(pdf.estrato).sum() / pdf.groupby("estrato").fep.sum()
    want = design_variance(pdf, w * (y * 1.0 - pdf.estrato.map(mean)))
    condition = (F.col("sexo") == "Mujer") & (F.col("trimestre") == "T2")
    long = survey_total(design.where(condition)).first()
    wide = stat_set(design, {"y": F.when(condition, 1.0)}).estimates().first()
    assert long["var"] == pytest.approx(want, rel=1e-8) and wide.se**2 == pytest.approx(want, rel=1e-8)
    # Calibrated totals are known, so they carry no error.
    exact = survey_total(design, ["estrato"]).collect()
    assert all(r.se < 1e-3 and r.total == pytest.approx(rng[r.estrato]) for r in exact)
    roll = {r.sexo: r for r in with_national(design, "sexo").collect()}
    assert roll["Nacional"].se < 1e-3
    women = pdf.sexo == "Mujer"
    mean = (pdf.fep * women).groupby(pdf.estrato).sum() / pdf.groupby("estrato").fep.sum()
    want = design_variance(pdf, w * (women * 1.0 - pdf.estrato.map(mean)))
    assert roll["Mujer"]["var"] == pytest.approx(want, rel=1e-8)


def test_residual_variance_on_margins(spark, people, pdf):
    def flag(c, v):
        return F.when(F.col(c) == v, 1.0).otherwise(0.0)

    terms = {"a1": flag("area", "1"), "a2": flag("area", "2"), "m": flag("sexo", "Mujer")}
    z = np.column_stack([pdf.area == "1", pdf.area == "2", pdf.sexo == "Mujer"]).astype(float)
    d = pdf.fep.to_numpy()
    totals = (d[:, None] * z).sum(0) * np.array([1.1, 0.95, 1.02])
    weighted = calibrate(people, "fep", terms, dict(zip(terms, totals)))
    got = weighted.agg(*[F.sum(F.col("w_cal") * e).alias(t) for t, e in terms.items()]).first()
    assert [got[t] for t in terms] == pytest.approx(list(totals))
    lam = np.linalg.solve(z.T @ (d[:, None] * z), totals - (d[:, None] * z).sum(0))
    w = d * (1 + z @ lam)
    y = (pdf.pobreza == 1).to_numpy() * 1.0
    beta = np.linalg.solve(z.T @ (d[:, None] * z), z.T @ (d * y))
    design = SurveyDesign(weighted, "w_cal", calibration=MarginCalibration("fep", terms))
    row = stat_set(design, {"y": F.when(F.col("pobreza") == 1, 1.0)}).estimates().first()
    assert row.estimate == pytest.approx((w * y).sum())
    assert row.se**2 == pytest.approx(design_variance(pdf, w * (y - z @ beta)), rel=1e-8)


def test_degrees_of_freedom(people, pdf):
    row = degrees_of_freedom(SurveyDesign(people, "fep").where(F.col("dam") == "1")).first()
    units = pdf.groupby("estrato").upm.nunique()
    assert row.df == (units - 1).sum()
    assert row.df_domain == (units[[s for s in units.index if s.startswith("1_")]] - 1).sum()


def test_lonely_unit_fails_or_contributes_nothing(people):
    first = people.where(F.col("dam") == "1").agg(F.min("upm")).first()[0]
    cut = (F.col("dam") != "1") | (F.col("upm") == first)
    with pytest.raises(Exception, match="single primary sampling unit"):
        survey_total(SurveyDesign(people, "fep").subset(cut)).collect()
    certain = survey_total(SurveyDesign(people, "fep", lonely_psu="certainty").subset(cut)).first()
    rest = survey_total(SurveyDesign(people, "fep").subset(F.col("dam") != "1")).first()
    assert certain["var"] == pytest.approx(rest["var"])


def test_unit_code_in_two_strata(people):
    mixed = people.withColumn("upm", F.col("upm") % 4)
    with pytest.raises(ValueError):
        SurveyDesign(mixed, "fep", nest=False).check_units()
    assert SurveyDesign(mixed, "fep").check_units().units().count() > 4


def test_planning_variances_are_ordered(spark):
    one = spark.range(1)
    v, r = F.lit(2.0), F.lit(0.6)

    def change(t):
        return one.select(change_variance(v, v, F.lit(t), F.lit(t), r)).first()[0]

    def mean(t):
        return one.select(mean_of_three_variance(v, F.lit(t), r)).first()[0]

    assert change(0.0) == pytest.approx(4.0) and change(0.5) == pytest.approx(4 * (1 - 0.3))
    assert change(1.0) < change(0.5) < change(0.0)
    assert mean(0.0) == pytest.approx(2 / 3) and mean(1.0) > mean(0.5) > mean(0.0)


def test_level_measures_names():
    assert list(level_measures({"a": None, "b": None}, {})) == []
