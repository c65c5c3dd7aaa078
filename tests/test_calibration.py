import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.operators.calibration import (
    calibrate, calibration_gaps, histogram, integrative, pick_controls, poststratify, uncovered_controls,
)
from rotapanel.operators.weights import annual_weights, quarterly_weights
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.controls import derive_controls
from rotapanel.sources.microdata import survey_base


@pytest.fixture(scope="module")
def controls(spark, sf):
    return derive_controls(spark, sf)


def test_closed_forms_equal_the_dense_system(spark, sf, controls):
    homes = annual_plan.household_sizes(annual_weights(survey_base(spark, sf)))
    goals = quarterly_plan.household_targets(controls, "N_personas")
    totals = {r.estrato: r.total for r in goals.collect()}
    names = sorted(totals)
    pdf = homes.toPandas()
    d, n = pdf.dk_anual.to_numpy(), pdf.n_personas.to_numpy()
    for size, got in (
        (n, integrative(homes, "dk_anual", "n_personas", goals, "total", ["estrato"])),
        (np.ones_like(n), poststratify(homes, "dk_anual", goals, "total", ["estrato"])),
    ):
        z = np.column_stack([(pdf.estrato == s) * size for s in names]).astype(float)
        want = np.array([totals[s] for s in names])
        lam = np.linalg.solve(z.T @ (d[:, None] * z), want - (d[:, None] * z).sum(0))
        dense = dict(zip(zip(pdf.trimestre, pdf.id_hogar), d * (1 + z @ lam)))
        for r in got.collect():
            assert r.w_cal == pytest.approx(dense[(r.trimestre, r.id_hogar)], rel=1e-9)


def test_general_calibration_agrees_with_poststratification(spark, sf, controls):
    people = survey_base(spark, sf, ["T1"])
    goals = quarterly_plan.household_targets(controls, "N_personas")
    totals = {r.estrato: r.total for r in goals.collect()}
    terms = {s: F.when(F.col("estrato") == s, 1.0).otherwise(0.0) for s in totals}
    a = calibrate(people, "fep", terms, totals).select("id_hogar", "id_pers", F.col("w_cal").alias("a"))
    b = poststratify(people, "fep", goals, "total", ["estrato"]).select("id_hogar", "id_pers", F.col("w_cal").alias("b"))
    gap = a.join(b, ["id_hogar", "id_pers"]).agg(F.max(F.abs(F.col("a") / F.col("b") - 1)), F.count("*")).first()
    assert gap[0] < 1e-10 and gap[1] == people.count()


def test_every_quarter_meets_its_totals(spark, sf, controls):
    homes = quarterly_plan.calibrated_households(quarterly_weights(survey_base(spark, sf)), controls)
    goals = quarterly_plan.household_targets(controls)
    for q in ("T1", "T2", "T3", "T4"):
        gaps = calibration_gaps(homes.where(F.col("trimestre") == q), "dk_mes_cali", goals, "total", ["estrato"]).collect()
        assert len(gaps) == 10 and all(r.dif < 1e-6 * r.control for r in gaps)


def test_persons_take_the_factor_or_the_household_weight(spark, sf, controls):
    people = quarterly_weights(survey_base(spark, sf))
    homes = quarterly_plan.calibrated_households(people, controls)
    keys = ["trimestre", "id_hogar", "id_pers"]
    a = quarterly_plan.attach_household_weight(people, homes, "dk_mes_cali").select(*keys, F.col("dk_mes_cali").alias("a"))
    b = quarterly_plan.calibrated_persons(survey_base(spark, sf), controls).select(*keys, F.col("dk_mes_cali").alias("b"))
    both = a.join(b, keys).agg(F.count("*"), F.max(F.abs(F.col("a") / F.col("b") - 1))).first()
    assert both[0] == people.count() and both[1] < 1e-12


def test_control_without_sample_is_reported(spark, sf, controls):
    people = survey_base(spark, sf).where(F.col("dam") != "4")
    goals = quarterly_plan.household_targets(controls)
    assert {r.estrato for r in uncovered_controls(people, goals, ["estrato"]).collect()} == {"4_1", "4_2"}


def test_picked_controls(spark):
    monthly = spark.createDataFrame([(t, m, 10.0 * m) for t in "ab" for m in (4, 5, 6)], "term string, mes int, total double")
    assert {r.total for r in pick_controls(monthly, "middle").collect()} == {50.0}
    assert {r.total for r in pick_controls(monthly, "mean").collect()} == {50.0}
    with pytest.raises(ValueError):
        pick_controls(monthly, "last")


def test_histogram_counts_every_row(spark, sf):
    people = survey_base(spark, sf)
    bins = histogram(people, "fep", 100).collect()
    assert sum(r.n for r in bins) == people.count() and all(1 <= r.bin <= 100 for r in bins)
    flat = histogram(people.withColumn("one", F.lit(1.0)), "one").collect()
    assert [(r.bin, r.n) for r in flat] == [(1, people.count())]
