import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.design import MarginCalibration, StratumCalibration, SurveyDesign
from rotapanel.operators.flow_errors import Likelihood, _derived, _fit, certificates, design_effects, flow_errors, model_tests
from rotapanel.operators.longitudinal import wide_states
from rotapanel.operators.markov import MODELS, cell_arrays, fit_tables, flow_standard_errors
from rotapanel.sources.microdata import survey_base
from test_markov import PUBLISHED

S1, S2, LEVELS = "pobreza_t1", "pobreza_t2", [1, 2, 3]


@pytest.fixture(scope="module")
def linked(spark, sf):
    people = survey_base(spark, sf, ["T1", "T2"])
    wide = wide_states(people, "pobreza", ["T1", "T2"])
    attributes = people.where("trimestre = 'T1'").select("id_hogar", "id_pers", "estrato", "upm", "sexo", "edad", "fep")
    return attributes.join(wide, ["id_hogar", "id_pers"]).cache()


def interior(seed, g=3):
    """Cells of a model with response probabilities well inside."""
    rng = np.random.default_rng(seed)
    f = rng.uniform(0.2, 1, (g, g)) + 2 * np.eye(g)
    f /= f.sum()
    rr, mm = rng.uniform(0.7, 0.9, g)[:, None], rng.uniform(0.3, 0.7, g)[:, None]
    t = np.zeros((g + 1, g + 1))
    t[:g, :g], t[:g, g] = 0.9 * rr * f, (0.9 * (1 - rr) * f).sum(1)
    t[g, :g], t[g, g] = (0.1 * (1 - mm) * f).sum(0), (0.1 * mm * f).sum()
    return t * 10_000


@pytest.mark.parametrize("model", list(MODELS))
@pytest.mark.parametrize("table", [PUBLISHED, interior(1), interior(2, 4)])
def test_influence_is_the_derivative_of_the_fit(model, table):
    g = len(table) - 1
    cells = table.ravel()
    at, t, held, converged = _fit(cells, g, model, True)
    influence, known = at.influence(t, held)
    assert converged and known
    _, values, slopes, _ = _derived(at, g, cells.sum(), 1.0)
    step, flat = 1e-5, slopes @ influence
    for cell in range(0, len(cells), 3):
        moved = []
        for sign in (1, -1):
            other = t.copy()
            other[cell] += sign * step
            near, _, also, _ = _fit(other, g, model, True)
            moved.append((_derived(near, g, 1.0, 1.0)[1], also))
        if (moved[0][1] == held).all() and (moved[1][1] == held).all():
            rise = (moved[0][0] - moved[1][0]) / (2 * step)
            # Shares sum to more or less than 1 after the step; the fit doesn't mind.
            np.testing.assert_allclose(flat[:, cell], rise, rtol=2e-2, atol=2e-3)


@pytest.mark.parametrize("model", list(MODELS))
def test_second_derivatives(model):
    rng = np.random.default_rng(3)
    f = rng.uniform(0.1, 1, (3, 3))
    f /= f.sum()
    axes = MODELS[model]

    def response(x, axis):
        return np.broadcast_to({"": x[:1, None], "i": x[:, None], "j": x[None]}[axis], (3, 3))

    base = [rng.uniform(0.2, 0.8, 3) for _ in range(3)]
    at = Likelihood.at(f, [response(x, a) for x, a in zip(base, axes)], axes)
    assert at.p.sum() == pytest.approx(1)
    for k, (name, i, j) in enumerate(at.names):
        def shifted(d):
            g, own = f.copy(), [b.copy() for b in base]
            if name == "f":
                g[i, j] += d
            else:
                own[["psi", "rho_rr", "rho_mm"].index(name)][i if i is not None else j if j is not None else 0] += d
            return Likelihood.at(g, [response(x, a) for x, a in zip(own, axes)], axes)
        up, down = shifted(1e-6), shifted(-1e-6)
        np.testing.assert_allclose(at.first[:, k], (up.p - down.p) / 2e-6, atol=1e-8)
        np.testing.assert_allclose(at.second[:, k], (up.first - down.first) / 2e-6, atol=1e-8)


@pytest.mark.parametrize("model", list(MODELS))
def test_errors_are_near_those_of_refits(linked, model):
    design = SurveyDesign(linked, "fep")
    linear = {(r.param, r.i, r.j): r for r in flow_errors(design, S1, S2, LEVELS, [model]).collect()}
    refits = {(r.param, r.i, r.j): r for r in flow_standard_errors(design, S1, S2, LEVELS, model).collect()}
    assert linear.keys() == refits.keys()
    ratio = {}
    for k, r in linear.items():
        assert r.value == pytest.approx(refits[k].value, rel=1e-4, abs=1e-6)
        if not r.at_bound and r.param in ("eta", "gamma", "psi", "rho_rr") or model == "A":
            ratio[k] = r.se / refits[k].se
    assert abs(np.median(list(ratio.values())) - 1) < 0.01
    if model == "A":
        assert all(abs(x - 1) < 0.02 for x in ratio.values())


def test_domains_and_calibrated_weights(linked):
    """By sex, the rows of one sex give what a design of all with this domain gives; residuals of calibrated weights shrink the error."""
    linked = linked.withColumn("d", F.col("fep") * 1.0)
    design = SurveyDesign(linked, "fep")
    both = flow_errors(design, S1, S2, LEVELS, ["A"], ["sexo"]).where("sexo = 'Mujer'").drop("sexo").collect()
    alone = flow_errors(design.where(F.col("sexo") == "Mujer"), S1, S2, LEVELS, ["A"]).collect()
    near = {(r.param, r.i, r.j): r for r in alone}
    assert len(both) == len(alone) and all(r.se == pytest.approx(near[r.param, r.i, r.j].se, rel=1e-8) for r in both)
    counted = SurveyDesign(linked, "fep", calibration=StratumCalibration("d"))
    terms = {f"h{k}": F.when(F.col("estrato") == h, 1.0).otherwise(0.0) for k, h in enumerate(r[0] for r in linked.select("estrato").distinct().collect())}
    margins = SurveyDesign(linked, "fep", calibration=MarginCalibration("d", terms))
    rows = [{(r.param, r.i, r.j): r.se for r in flow_errors(d, S1, S2, LEVELS, ["A"]).collect()} for d in (design, counted, margins)]
    # One term per stratum is the calibration to counts; the total of all flows has no error then.
    assert all(rows[1][k] == pytest.approx(rows[2][k], rel=1e-6) for k in rows[1])
    flows = [k for k in rows[0] if k[0] == "muij"]
    assert sum(rows[1][k] for k in flows) < sum(rows[0][k] for k in flows)
    wide = {(r.param, r.i, r.j): r for r in flow_errors(design, S1, S2, LEVELS, ["A"], population=1000.0).collect()}
    assert sum(wide[k].value for k in flows) == pytest.approx(1000)


def test_certificates_hold_at_the_fit_only(spark, linked):
    arrays = cell_arrays(linked, S1, S2, LEVELS, "fep", ["sexo"])
    rows = certificates(arrays, LEVELS, by=["sexo"]).collect()
    assert {(r.sexo, r.model) for r in rows} == {(s, m) for s in ("Hombre", "Mujer") for m in MODELS}
    assert all(r.holds for r in rows) and any(r.bound is not None for r in rows)
    at, t, held, _ = _fit(PUBLISHED.ravel(), 4, "C", True)
    moved = Likelihood.at(at.value[:16].reshape(4, 4), [np.full((4, 4), x) for x in (0.95, 0.9, 0.5)], MODELS["A"])
    assert np.abs(moved.slope(t)).max() > 1e-3
    # Any other point of the model has a lower likelihood.
    rng, best = np.random.default_rng(1), (t * np.log(at.p)).sum()
    fit = fit_tables(PUBLISHED[None], "C")
    for _ in range(50):
        f = fit["muij"][0] / fit["muij"].sum() * rng.uniform(0.97, 1.03, (4, 4))
        other = Likelihood.at(f / f.sum(), [np.clip(fit[c][0] * rng.uniform(0.97, 1.03), 1e-4, 1) for c in ("psi", "rho_rr", "rho_mm")], MODELS["C"])
        assert (t * np.log(np.maximum(other.p, 1e-300))).sum() < best


def test_simple_sampling_has_design_effects_of_one():
    """At an exact fit; where the model is only near, they are near 1."""
    for model, df, near in (("A", 6, 0.2), ("B", 3, 0.2), ("C", 0, 0)):
        at, t, held, _ = _fit(interior(4, 4).ravel(), 4, model, True)
        found, effects = design_effects(at, t, held, (np.diag(at.p) - np.outer(at.p, at.p)) / 500, 500)
        assert found == df and effects[:df] == pytest.approx(np.ones(df), abs=near)
    exact = at.p.copy()
    for model in "AC":
        fitted, t, held, _ = _fit(_fit(exact, 4, "A", True)[0].p, 4, model, True)
        df, effects = design_effects(fitted, t, held, (np.diag(fitted.p) - np.outer(fitted.p, fitted.p)) / 500, 500)
        assert effects == pytest.approx((np.arange(len(effects)) < df).astype(float), abs=1e-6)


def test_tests_of_fit(linked):
    rows = model_tests(SurveyDesign(linked, "fep"), S1, S2, LEVELS, by=["sexo"]).collect()
    assert len(rows) == 8 and sum(r.chosen for r in rows) == 2
    n = {r.sexo: r["count"] for r in linked.groupBy("sexo").count().collect()}
    for r in rows:
        assert r.n == n[r.sexo] and r.converged
        if r.p is not None:
            # Below the residual degrees of freedom where a model fits; with a misfit the residual moves in more directions.
            assert 0 < r.df_rs < 15 and r.chi2_rs >= 0 and 0 <= r.p <= 1 and (r.model != "A" or r.df_rs <= 1.01 * r.df)
    best = {r.sexo: r.p for r in rows if r.chosen}
    assert all(r.p is None or r.p <= best[r.sexo] for r in rows)
