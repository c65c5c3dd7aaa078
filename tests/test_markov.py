import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.markov import (
    MODELS, cell_arrays, cell_measures, degrees_of_freedom, fit_flow_model, fit_tables, flow_standard_errors,
    goodness_of_fit,
)
from rotapanel.operators.replication import (
    bootstrap_totals, full_totals, half_sample_totals, jackknife_totals, replicate_variance, unit_vectors,
)
from rotapanel.operators.estimation import survey_total
from rotapanel.operators.longitudinal import wide_states
from rotapanel.sources.microdata import survey_base

# Published weighted flow table (last row and column are non-response).
PUBLISHED = np.array(
    [
        [3269673, 201639, 175719, 503740, 155902],
        [232095, 641565, 146416, 725006, 58649],
        [55243, 50337, 157642, 233597, 26695],
        [102490, 161363, 98898, 4299066, 118393],
        [47104, 26276, 19746, 100775, 25545],
    ],
    dtype=float,
)
POPULATION = 15597572
FLOWS = [
    [4627632, 287124, 252084, 713284],
    [327066, 911996, 210372, 1022351],
    [79346, 72944, 230949, 335746],
    [143303, 227545, 140923, 6014907],
]
TRANSITIONS = [[0.787, 0.048, 0.042, 0.121], [0.132, 0.368, 0.085, 0.413], [0.110, 0.101, 0.321, 0.466], [0.021, 0.034, 0.021, 0.921]]
ETA, RR, MM, PSI = [0.376, 0.158, 0.046, 0.418], [0.963, 0.967, 0.949, 0.975], [0.304, 0.0, 0.0, 0.017], 0.981


def printed(x, digits):
    """Equal to the printed digits, which are partly rounded and partly cut."""
    return (np.abs(np.asarray(x) - digits) < 0.001).all()


def test_published_model_c():
    fit = fit_tables(PUBLISHED[None], "C")
    assert fit["converged"].all()
    flows = fit["muij"][0] / fit["muij"].sum() * POPULATION
    assert np.abs(flows - FLOWS).max() < 5
    assert printed(fit["pij"][0], TRANSITIONS)
    assert printed(fit["eta"][0], ETA)
    assert printed(fit["rho_rr"][0, :, 0], RR)
    assert printed(fit["rho_mm"][0, :, 0], MM)
    assert printed(fit["psi"][0, 0, 0], PSI)


@pytest.mark.parametrize("model", list(MODELS))
def test_no_plain_step_improves_the_fit(model):
    """A long run of textbook EM from the estimate stays where it is."""
    fit = fit_tables(PUBLISHED[None], model)
    t = PUBLISHED / PUBLISHED.sum()
    f, psi, rr, mm = fit["muij"][0] / PUBLISHED.sum(), fit["psi"][0], fit["rho_rr"][0], fit["rho_mm"][0]
    n, r, c, m = t[:4, :4], t[:4, 4:], t[4:, :4], t[4, 4]

    def pooled(top, bottom, axis):
        if axis == "":
            return np.full((4, 4), top.sum() / bottom.sum())
        k = 1 if axis == "i" else 0
        return np.broadcast_to(top.sum(k, keepdims=True) / bottom.sum(k, keepdims=True), (4, 4))

    f0 = f
    for _ in range(500):
        lost = f * psi * (1 - rr)
        found = f * (1 - psi) * (1 - mm)
        never = f * (1 - psi) * mm
        row = r * lost / lost.sum(1, keepdims=True)
        col = c * found / found.sum(0, keepdims=True)
        both = m * never / never.sum()
        answered, silent = n + row, col + both
        everyone = answered + silent
        f = everyone / everyone.sum()
        psi, rr, mm = (
            pooled(a, b, x) for (a, b), x in zip(((answered, everyone), (n, answered), (both, silent)), MODELS[model])
        )
    assert np.abs(f - f0).max() < 1e-8


def test_model_properties():
    fits = {m: fit_tables(np.stack([PUBLISHED, PUBLISHED.T, PUBLISHED * 3]), m) for m in MODELS}
    for m, fit in fits.items():
        assert np.allclose(fit["pij"].sum(2), 1) and np.allclose(fit["eta"].sum(1), 1)
        assert np.allclose(fit["gamma"], (fit["eta"][:, :, None] * fit["pij"]).sum(1))
        assert np.allclose(fit["fitted"].sum((1, 2)), 1)
        assert np.allclose(fit["pij"][0], fit["pij"][2])
    assert [degrees_of_freedom(m, 4) for m in "ABCD"] == [7, 4, 1, 1]


def test_zero_flows_stay_zero():
    table = PUBLISHED.copy()
    table[0, 2] = 0
    assert fit_tables(table[None], "C")["pij"][0, 0, 2] == 0
    assert fit_tables(table[None], "C", zero_flows=False)["pij"][0, 0, 2] > 0


@pytest.fixture(scope="module")
def linked(spark, sf):
    people = survey_base(spark, sf, ["T1", "T2"])
    wide = wide_states(people, "pobreza", ["T1", "T2"])
    attributes = people.where("trimestre = 'T1'").select("id_hogar", "id_pers", "estrato", "upm", "sexo", "fep")
    return attributes.join(wide, ["id_hogar", "id_pers"]).cache()


def test_spark_fit_equals_local_fit(linked):
    arrays = cell_arrays(linked, "pobreza_t1", "pobreza_t2", [1, 2, 3], "fep", ["sexo"])
    rows = fit_flow_model(arrays, [1, 2, 3], "C", ["sexo"]).collect()
    pdf = linked.toPandas()
    for sex in ("Hombre", "Mujer"):
        part = pdf[pdf.sexo == sex]
        table = np.zeros((4, 4))
        for a, b, w in zip(part.pobreza_t1.fillna(4), part.pobreza_t2.fillna(4), part.fep):
            table[int(a) - 1, int(b) - 1] += w
        fit = fit_tables(table[None], "C")
        for r in rows:
            if r.sexo == sex and r.param == "pij":
                assert r.value == pytest.approx(fit["pij"][0, int(r.i) - 1, int(r.j) - 1], abs=1e-8)
            if r.sexo == sex and r.param == "muij":
                assert r.value == pytest.approx(fit["muij"][0, int(r.i) - 1, int(r.j) - 1], rel=1e-7, abs=1e-4)


def test_standard_errors_equal_refits_without_each_unit(linked):
    got = {(r.param, r.i, r.j): r for r in flow_standard_errors(
        SurveyDesign(linked, "fep"), "pobreza_t1", "pobreza_t2", [1, 2, 3], "A"
    ).collect()}
    pdf = linked.toPandas().fillna({"pobreza_t1": 4, "pobreza_t2": 4})

    def table(weights):
        out = np.zeros((4, 4))
        np.add.at(out, (pdf.pobreza_t1.astype(int).to_numpy() - 1, pdf.pobreza_t2.astype(int).to_numpy() - 1), weights)
        return out

    w = pdf.fep.to_numpy()
    whole = fit_tables(table(w)[None], "A")
    tables, factors = [], []
    for h, units in pdf.groupby("estrato").upm.unique().items():
        n = len(units)
        for u in units:
            scale = np.where(pdf.estrato == h, np.where(pdf.upm == u, 0.0, n / (n - 1)), 1.0)
            tables.append(table(w * scale))
            factors.append((n - 1) / n)
    fits = fit_tables(np.stack(tables), "A")
    factors = np.array(factors)
    for i in range(3):
        for j in range(3):
            d = fits["pij"][:, i, j] - whole["pij"][0, i, j]
            r = got[("pij", str(i + 1), str(j + 1))]
            assert r.value == pytest.approx(whole["pij"][0, i, j], abs=1e-8)
            assert r.se == pytest.approx(np.sqrt((factors * d * d).sum()), rel=1e-4)
    assert got[("psi", None, None)].se > 0


def test_goodness_of_fit_scales_pearson(linked):
    rows = {r.model: r for r in goodness_of_fit(SurveyDesign(linked, "fep"), "pobreza_t1", "pobreza_t2", [1, 2, 3]).collect()}
    n = linked.count()
    cells = cell_arrays(linked, "pobreza_t1", "pobreza_t2", [1, 2, 3], "fep").first()
    p = np.array(cells.cells).reshape(1, 4, 4)
    p = p / p.sum()
    for m, r in rows.items():
        want = fit_tables(p, m)["fitted"]
        assert r.chi2 == pytest.approx(n * ((p - want) ** 2 / want).sum(), rel=1e-6, abs=1e-6)
        assert r.chi2_rs == pytest.approx(r.chi2 / r.deff) and r.df == degrees_of_freedom(m, 3)
    assert rows["A"].chi2 >= rows["C"].chi2 - 1e-6


def test_jackknife_of_a_total_is_the_linear_variance(spark, sf):
    design = SurveyDesign(survey_base(spark, sf), "fep")
    measures = {"w": F.col("ingreso")}
    units = unit_vectors(design, measures)
    got = replicate_variance(jackknife_totals(design, units, 1), full_totals(units, 1), {"w": lambda c: c[0]}).first()
    want = survey_total(design, y=F.col("ingreso")).first()
    assert got.estimate == pytest.approx(want.total) and got["var"] == pytest.approx(want["var"], rel=1e-8)
    boot = replicate_variance(bootstrap_totals(units, 1, 400), full_totals(units, 1), {"w": lambda c: c[0]}).first()
    assert boot["var"] == pytest.approx(want["var"], rel=0.3)


def test_half_samples_of_paired_units(spark):
    # Two units per stratum: the half-sample variance of a total is exact.
    rows = spark.createDataFrame(
        [(f"h{h}", 10 * h + i, 1.0, float(v)) for h, pair in enumerate([(1, 4), (2, 9), (5, 5), (7, 1), (3, 8)]) for i, v in enumerate(pair)],
        "estrato string, upm long, w double, y double",
    )
    design = SurveyDesign(rows, "w")
    units = unit_vectors(design, {"y": F.col("y")})
    got = replicate_variance(half_sample_totals(units, 1), full_totals(units, 1), {"y": lambda c: c[0]}).first()
    assert got["var"] == pytest.approx(survey_total(design, y=F.col("y")).first()["var"])


def test_cell_names():
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    assert len(cell_measures("a", "b", [1, 2, 3])) == 16
