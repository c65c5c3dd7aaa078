"""Joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import (
    ANNUAL_CAL, PANEL, PANEL_FINAL, PANEL_PROBABILITY, QUARTERLY, QUARTERLY_CAL, annual, base, controls, quarterly, rounded, sql,
)
from rotapanel.catalog.registry import query
from rotapanel.operators.calibration import calibration_gaps
from rotapanel.operators.flows import answered_both, flow_weights, row_complement
from rotapanel.operators.longitudinal import (
    PERSON, basic_weight, household_panel, persons_of_panel, wide_states, with_household_weight, with_person_flag,
)
from rotapanel.operators.overlap import shared_units
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan


@query("c1_join_period_factor", sql("""
SELECT id_hogar, id_pers, trimestre, mes_trimestre, ai, dk_mes FROM ajus""", QUARTERLY))
def join_period_factor(spark, sf):
    return quarterly(spark, sf).select(*PERSON, "trimestre", "mes_trimestre", "ai", "dk_mes")


@query("c2_join_on_common_columns", sql("""
SELECT trimestre, mes_trimestre, count(*) AS n, round(sum(dk_mes_cali), 2) AS total FROM cali GROUP BY 1, 2""",
    QUARTERLY_CAL))
def join_on_common_columns(spark, sf):
    people = quarterly(spark, sf)
    homes = quarterly_plan.calibrated_households(people, controls(spark, sf)).select(*quarterly_plan.HOME, "dk_mes_cali")
    common = [c for c in people.columns if c in homes.columns]
    return people.join(homes, common).groupBy("trimestre", "mes_trimestre").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("dk_mes_cali"), 2).alias("total")
    )


@query("c3_join_many_keys", sql("""
SELECT trimestre, mes_trimestre, estrato, dam, upm, id_hogar, n_personas, dk_anual FROM hog2""", ANNUAL_CAL))
def join_many_keys(spark, sf):
    people = annual(spark, sf)
    keys = ["trimestre", "mes_trimestre", "estrato", "dam", "upm", "id_hogar"]
    sizes = people.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_personas"))
    reps = people.where(F.col("id_pers") == 1).select(*keys, "dk_anual")
    return sizes.join(reps, keys)


@query("c4_semi_join_repeated", sql("""
SELECT DISTINCT trimestre, mes_trimestre, upm FROM base
WHERE upm IN (SELECT upm FROM (SELECT DISTINCT trimestre, mes_trimestre, upm FROM base) GROUP BY 1 HAVING count(*) > 1)"""))
def semi_join_repeated(spark, sf):
    units = base(spark, sf).select("trimestre", "mes_trimestre", "upm").distinct()
    repeated = units.groupBy("upm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return units.join(repeated, "upm", "left_semi")


@query("c5_join_first_weight", sql("SELECT id_hogar, trimestre, upm, fep, fep_t1, respboth FROM hogpanel", PANEL))
def join_first_weight(spark, sf):
    panel = household_panel(base(spark, sf), "T1", "T2")
    return panel.select("id_hogar", "trimestre", "upm", "fep", "fep_t1", "respboth")


@query("c6_join_household_weight", sql("""
SELECT id_hogar, id_pers, trimestre, respboth_per, fep_long FROM gente""", PANEL))
def join_household_weight(spark, sf):
    people = with_person_flag(persons_of_panel(base(spark, sf), "T1", "T2"), "T1", "T2")
    panel = household_panel(base(spark, sf), "T1", "T2").withColumn("fep_long", basic_weight(PANEL_PROBABILITY))
    return with_household_weight(people, panel).select(*PERSON, "trimestre", "respboth_per", "fep_long")


@query("c7_join_wide_states", sql("""
SELECT a.id_hogar, a.id_pers, a.sexo, a.edad, a.pobreza AS pobreza_t1, b.pobreza AS pobreza_t2
FROM (SELECT * FROM gente WHERE trimestre = 'T1' AND respboth_per = 1) a
JOIN (SELECT * FROM gente WHERE trimestre = 'T2') b USING (id_hogar, id_pers)""", PANEL))
def join_wide_states(spark, sf):
    people = with_person_flag(persons_of_panel(base(spark, sf), "T1", "T2"), "T1", "T2").where("respboth_per = 1")
    attributes = people.where(F.col("trimestre") == "T1").select(*PERSON, "sexo", "edad")
    return attributes.join(wide_states(people, "pobreza", ["T1", "T2"]), PERSON)


@query("c8_left_join_complement", sql("""
SELECT m.pobreza_t1 AS state_1, m.n, coalesce(r.n, 0) AS complemento_fila
FROM (SELECT pobreza_t1, count(*) AS n FROM panel WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NOT NULL GROUP BY 1) m
LEFT JOIN (SELECT pobreza_t1, count(*) AS n FROM panel WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NULL GROUP BY 1) r
  ON m.pobreza_t1 = r.pobreza_t1""", PANEL_FINAL))
def left_join_complement(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    cells = flow_weights(final, "pobreza_t1", "pobreza_t2", "fex_cali")
    body = answered_both(cells).groupBy("state_1").agg(F.sum("n").alias("n"))
    return body.join(row_complement(cells, "n"), "state_1", "left").fillna(0, ["complemento_fila"])


@query("c9_compare_with_controls", sql("""
SELECT estrato, round(sum(dk_anual_calib * n_personas), 2) AS total, any_value(t_per) AS control,
       round(abs(sum(dk_anual_calib * n_personas) - any_value(t_per)), 2) AS dif
FROM hogcal2 JOIN metas USING (estrato) GROUP BY 1""", ANNUAL_CAL))
def compare_with_controls(spark, sf):
    homes = annual_plan.calibrated_households(annual(spark, sf), controls(spark, sf))
    targets = quarterly_plan.household_targets(controls(spark, sf), "N_personas")
    gaps = calibration_gaps(homes, "dk_anual_calib", targets, "total", ["estrato"], "n_personas")
    return rounded(gaps, total=2, dif=2)


@query("c10_period_pairs", sql("""
SELECT a.trimestre AS trimestre_1, b.trimestre AS trimestre_2, count(*) AS traslape
FROM (SELECT DISTINCT id_hogar, trimestre FROM base) a JOIN (SELECT DISTINCT id_hogar, trimestre FROM base) b
  ON a.id_hogar = b.id_hogar AND a.trimestre < b.trimestre GROUP BY 1, 2"""))
def period_pairs(spark, sf):
    return shared_units(base(spark, sf), ["id_hogar"])
