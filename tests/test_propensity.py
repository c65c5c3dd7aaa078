import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.longitudinal import person_panel
from rotapanel.operators.propensity import auc, coefficients, fit_response, predict_response, roc_points
from rotapanel.plans.panel import scored_panel
from rotapanel.sources.microdata import survey_base


def logit_by_newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ ((p * (1 - p))[:, None] * x)))), p


@pytest.fixture(scope="module")
def people(spark, sf):
    return person_panel(survey_base(spark, sf), "T1", "T2", 0.75).cache()


def test_logit_matches_newton(people):
    model = fit_response(people, "respboth_per", ["sexo", "ingreso"])
    pdf = people.toPandas()
    x = np.column_stack([pdf.sexo == "Mujer", pdf.ingreso, np.ones(len(pdf))]).astype(float)
    scale = np.array([1, 1e5, 1])
    beta, se, p = logit_by_newton(x / scale, pdf.respboth_per.to_numpy(float))
    rows = {r.term: r for r in coefficients(model, people).collect()}
    assert list(rows) == ["sexo_Mujer", "ingreso", "(Intercept)"]
    for name, b, s, k in zip(rows, beta, se, scale):
        assert rows[name].estimate == pytest.approx(b / k, rel=1e-5)
        assert rows[name].se == pytest.approx(s / k, rel=1e-5)
    keys = ["id_hogar", "id_pers", "trimestre"]
    scored = predict_response(model, people, ["sexo", "ingreso"]).select(*keys, "prob_resp").toPandas()
    joined = pdf.assign(want=p).merge(scored, on=keys)
    assert len(joined) == len(pdf) and np.allclose(joined.want, joined.prob_resp, atol=1e-6)


def test_rows_with_missing_covariates_are_kept_without_score(people):
    model = fit_response(people, "respboth_per", ["pobreza", "edad"])
    scored = predict_response(model, people, ["pobreza", "edad"])
    counts = scored.agg(F.count("*").alias("n"), F.count("prob_resp").alias("k")).first()
    assert counts.n == people.count()
    assert counts.k == people.where(F.col("pobreza").isNotNull()).count()


def test_single_class_is_refused(people):
    with pytest.raises(ValueError):
        fit_response(people.where("respboth_per = 1"), "respboth_per", ["edad"])


def test_area_under_curve_counts_pairs(people):
    scored = people.withColumn("s", F.round(F.col("edad") / 10.0, 0))
    pdf = scored.select("respboth_per", "s").toPandas()
    pos, neg = pdf[pdf.respboth_per == 1].s.to_numpy(), pdf[pdf.respboth_per == 0].s.to_numpy()
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc(scored, "respboth_per", "s").first().auc == pytest.approx(wins)
    points = roc_points(scored, "respboth_per", "s").orderBy("score").collect()
    assert points[0].sensitivity == 1 and points[0].specificity == 0
    assert all(a.sensitivity >= b.sensitivity and a.specificity <= b.specificity for a, b in zip(points, points[1:]))


def test_weights_are_divided_by_the_score(spark, sf):
    scored = scored_panel(survey_base(spark, sf), 0.75, ["sexo", "ingreso"])
    bad = scored.where(F.abs(F.col("fep_aj") * F.col("prob_resp") - F.col("fep_long")) > 1e-9).count()
    assert bad == 0 and scored.where("fep_aj < fep_long").count() == 0
