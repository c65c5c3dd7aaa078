"""Calibration of weights."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import (
    ANNUAL_CAL, PANEL_FINAL, QUARTERLY, QUARTERLY_CAL, TARGETS, annual, base, controls, quarterly, rounded, sql,
)
from rotapanel.catalog.registry import query
from rotapanel.operators.calibration import (
    calibrate, pick_controls, poststratify, uncovered_controls, unmatched_cells, weight_summary,
)
from rotapanel.operators.estimation import survey_total, with_national
from rotapanel.operators.longitudinal import PERSON
from rotapanel.operators.weights import month_index
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.controls import control_terms


def _scored(spark, sf):
    return panel_plan.scored_panel(base(spark, sf), 0.75)


def _final(spark, sf):
    return panel_plan.final_base(_scored(spark, sf), controls(spark, sf), "pobreza")


def margin_terms():
    """Terms of the model area + sex without intercept."""

    def flag(col, value):
        return F.when(F.col(col) == value, 1.0).otherwise(0.0)

    return {"area1": flag("area", "1"), "area2": flag("area", "2"), "sexoMujer": flag("sexo", "Mujer")}


def margin_totals(spark, sf):
    """Area totals from the controls; women are 52 % of the population, in whole persons."""
    by_area = {r.area: r.n for r in controls(spark, sf).groupBy("area").agg(F.sum("N_personas").alias("n")).collect()}
    women = float(int((by_area["1"] + by_area["2"]) * 52 // 100))
    return {"area1": by_area["1"], "area2": by_area["2"], "sexoMujer": women}


# Three equations in three unknowns by Cramer's rule: S l = t - t_hat.
MARGINS_SQL = """, tot AS (
  SELECT sum(N_personas) FILTER (area = '1') AS t1, sum(N_personas) FILTER (area = '2') AS t2,
         floor(sum(N_personas) * 52 / 100) AS t3 FROM poblacion),
sumas AS (
  SELECT sum(d) FILTER (area = '1') AS a, sum(d) FILTER (area = '2') AS b, sum(d) FILTER (sexo = 'Mujer') AS c,
         sum(d) FILTER (area = '1' AND sexo = 'Mujer') AS ac, sum(d) FILTER (area = '2' AND sexo = 'Mujer') AS bc
  FROM src),
brecha AS (SELECT *, t1 - a AS g1, t2 - b AS g2, t3 - c AS g3, a * (b * c - bc * bc) - b * ac * ac AS det FROM sumas, tot),
lam3 AS (
  SELECT (g1 * (b * c - bc * bc) - ac * (b * g3 - g2 * bc)) / det AS l1,
         (a * (g2 * c - bc * g3) - ac * (ac * g2 - 0) + ac * bc * g1) / det AS l2,
         (a * (b * g3 - bc * g2) - ac * b * g1) / det AS l3 FROM brecha),
margen AS (
  SELECT s.*, d * (1 + (CASE WHEN area = '1' THEN l1 ELSE l2 END) + (CASE WHEN sexo = 'Mujer' THEN l3 ELSE 0 END)) AS w
  FROM src s, lam3)
"""


@query("i1_calibration_targets", sql("""
SELECT 'hh_' || estrato AS term, t_hog AS hogares, t_per AS personas FROM metas""", TARGETS))
def targets(spark, sf):
    population = controls(spark, sf)
    homes = control_terms(population, "N_hogares", "hh_").withColumnRenamed("total", "hogares")
    persons = control_terms(population, "N_personas", "hh_").withColumnRenamed("total", "personas")
    return homes.join(persons, "term")


@query("i2_linear_calibration", sql(
    "SELECT id_hogar, id_pers, trimestre, round(w, 4) AS w_cal FROM margen",
    ", src AS (SELECT *, fep AS d FROM base)",
    MARGINS_SQL,
))
def linear_calibration(spark, sf):
    people = base(spark, sf)
    out = calibrate(people, "fep", margin_terms(), margin_totals(spark, sf))
    return rounded(out.select(*PERSON, "trimestre", "w_cal"), w_cal=4)


# The same three equations, per quarter.
MARGINS_EACH_SQL = """, tot AS (
  SELECT sum(N_personas) FILTER (area = '1') AS t1, sum(N_personas) FILTER (area = '2') AS t2,
         floor(sum(N_personas) * 52 / 100) AS t3 FROM poblacion),
sumas AS (
  SELECT trimestre, sum(fep) FILTER (area = '1') AS a, sum(fep) FILTER (area = '2') AS b, sum(fep) FILTER (sexo = 'Mujer') AS c,
         sum(fep) FILTER (area = '1' AND sexo = 'Mujer') AS ac, sum(fep) FILTER (area = '2' AND sexo = 'Mujer') AS bc
  FROM base GROUP BY 1),
brecha AS (SELECT *, t1 - a AS g1, t2 - b AS g2, t3 - c AS g3, a * (b * c - bc * bc) - b * ac * ac AS det FROM sumas, tot),
lam3 AS (
  SELECT trimestre, (g1 * (b * c - bc * bc) - ac * (b * g3 - g2 * bc)) / det AS l1,
         (a * (g2 * c - bc * g3) - ac * (ac * g2) + ac * bc * g1) / det AS l2,
         (a * (b * g3 - bc * g2) - ac * b * g1) / det AS l3 FROM brecha)
"""


@query("i4_margins_each_quarter", sql(
    """
SELECT id_hogar, id_pers, trimestre,
       round(fep * (1 + (CASE WHEN area = '1' THEN l1 ELSE l2 END) + (CASE WHEN sexo = 'Mujer' THEN l3 ELSE 0 END)), 4) AS w_cal
FROM base JOIN lam3 USING (trimestre)""",
    MARGINS_EACH_SQL,
))
def margins_each_quarter(spark, sf):
    out = calibrate(base(spark, sf), "fep", margin_terms(), margin_totals(spark, sf), within=["trimestre"])
    return rounded(out.select(*PERSON, "trimestre", "w_cal"), w_cal=4)


@query("i3_poststratify_households", sql("""
SELECT id_hogar, trimestre, round(dk_mes_cali, 6) AS dk_mes_cali, round(dk_mes_cali / dk_mes, 9) AS g
FROM hogcal""", QUARTERLY_CAL))
def poststratify_households(spark, sf):
    homes = quarterly_plan.household_file(quarterly(spark, sf), "dk_mes")
    targets = quarterly_plan.household_targets(controls(spark, sf))
    out = poststratify(homes, "dk_mes", targets, "total", ["estrato"], ["trimestre"], "dk_mes_cali")
    out = out.withColumn("g", F.col("dk_mes_cali") / F.col("dk_mes"))
    return rounded(out.select("id_hogar", "trimestre", "dk_mes_cali", "g"), dk_mes_cali=6, g=9)


@query("i4_calibrate_each_quarter", sql("""
SELECT trimestre, estrato, round(sum(dk_mes_cali), 4) AS total, any_value(t_hog) AS control, count(*) AS n
FROM hogcal JOIN metas USING (estrato) GROUP BY 1, 2""", QUARTERLY_CAL))
def calibrate_each_quarter(spark, sf):
    homes = quarterly_plan.calibrated_households(quarterly(spark, sf), controls(spark, sf))
    sums = homes.groupBy("trimestre", "estrato").agg(
        F.round(F.sum("dk_mes_cali"), 4).alias("total"), F.count(F.lit(1)).alias("n")
    )
    targets = quarterly_plan.household_targets(controls(spark, sf)).withColumnRenamed("total", "control")
    return sums.join(targets, "estrato")


@query("i5_integrative_calibration", sql("""
SELECT trimestre, id_hogar, n_personas, round(dk_anual_calib, 6) AS dk_anual_calib FROM hogcal2""", ANNUAL_CAL))
def integrative_calibration(spark, sf):
    homes = annual_plan.calibrated_households(annual(spark, sf), controls(spark, sf))
    return rounded(homes.select("trimestre", "id_hogar", "n_personas", "dk_anual_calib"), dk_anual_calib=6)


@query("i6_calibrate_longitudinal_persons", sql("""
SELECT id_hogar, id_pers, round(fex_cali, 6) AS fex_cali FROM final""", PANEL_FINAL))
def calibrate_longitudinal(spark, sf):
    return rounded(_final(spark, sf).select(*PERSON, "fex_cali"), fex_cali=6)


@query("i7_calibrate_on_margins", sql(
    """
SELECT area, sexo, count(*) AS n, round(sum(w), 2) AS total, round(min(w), 6) AS menor, round(max(w), 6) AS mayor
FROM margen GROUP BY 1, 2""",
    PANEL_FINAL,
    ", src AS (SELECT *, fep_aj AS d FROM final)",
    MARGINS_SQL,
))
def calibrate_on_margins(spark, sf):
    out = calibrate(_final(spark, sf), "fep_aj", margin_terms(), margin_totals(spark, sf))
    sums = out.groupBy("area", "sexo").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w_cal").alias("total"), F.min("w_cal").alias("menor"), F.max("w_cal").alias("mayor")
    )
    return rounded(sums, total=2, menor=6, mayor=6)


@query("i8_extract_weights", sql("""
SELECT trimestre, id_hogar, round(dk_mes_cali, 6) AS peso FROM hogcal WHERE trimestre = 'T2'""", QUARTERLY_CAL))
def extract_weights(spark, sf):
    design = quarterly_plan.household_design(base(spark, sf), controls(spark, sf), "T2")
    return design.df.select("trimestre", "id_hogar", F.round(design.weight, 6).alias("peso"))


@query("i9_household_weight_to_persons", sql("""
SELECT id_hogar, id_pers, trimestre, round(dk_mes_cali, 6) AS dk_mes_cali FROM cali""", QUARTERLY_CAL))
def household_weight_to_persons(spark, sf):
    people = quarterly(spark, sf)
    homes = quarterly_plan.calibrated_households(people, controls(spark, sf))
    out = quarterly_plan.attach_household_weight(people, homes, "dk_mes_cali")
    return rounded(out.select(*PERSON, "trimestre", "dk_mes_cali"), dk_mes_cali=6)


@query("i9_calibration_factor_to_persons", sql("""
SELECT id_hogar, id_pers, trimestre, round(dk_mes_cali, 6) AS dk_mes_cali FROM cali""", QUARTERLY_CAL))
def calibration_factor_to_persons(spark, sf):
    out = quarterly_plan.calibrated_persons(base(spark, sf), controls(spark, sf))
    return rounded(out.select(*PERSON, "trimestre", "dk_mes_cali"), dk_mes_cali=6)


@query("i10_validate_by_stratum", sql("""
SELECT estrato, round(sum(fex_cali), 4) AS total, any_value(t_per) AS control, count(DISTINCT upm) AS n_upm,
       0.0::DOUBLE AS se
FROM final JOIN metas USING (estrato) GROUP BY 1""", PANEL_FINAL))
def validate_by_stratum(spark, sf):
    final = _final(spark, sf)
    design = panel_plan.panel_design(final, residual=True)
    totals = survey_total(design, ["estrato"]).select("estrato", F.round("total", 4).alias("total"), F.round("se", 1).alias("se"))
    units = design.strata_sizes().withColumnRenamed("n_psu", "n_upm")
    goals = quarterly_plan.household_targets(controls(spark, sf), "N_personas").withColumnRenamed("total", "control")
    return totals.join(units, "estrato").join(goals, "estrato")


@query("i10_validate_rollup", sql("""
SELECT coalesce(sexo, 'Nacional') AS sexo, round(sum(fex_cali), 2) AS total FROM final GROUP BY ROLLUP (sexo)""", PANEL_FINAL))
def validate_rollup(spark, sf):
    design = panel_plan.panel_design(_final(spark, sf), residual=True)
    return rounded(with_national(design, "sexo").select("sexo", "total"), total=2)


@query("i10_uncovered_controls", sql("""
SELECT count(*) AS sin_muestra FROM metas WHERE estrato NOT IN (SELECT estrato FROM final)""", PANEL_FINAL))
def uncovered(spark, sf):
    goals = quarterly_plan.household_targets(controls(spark, sf), "N_personas")
    return uncovered_controls(_final(spark, sf), goals, ["estrato"]).agg(F.count(F.lit(1)).alias("sin_muestra"))


@query("i10_unmatched_cells", sql("""
, s AS (SELECT id_hogar, count(*) AS n FROM base WHERE trimestre = 'T2' GROUP BY 1),
c AS (SELECT id_hogar, count(*) AS n FROM base WHERE trimestre = 'T1' GROUP BY 1)
SELECT CASE WHEN c.n IS NULL THEN 'sample' ELSE 'control' END AS side, count(*) AS celdas, CAST(sum(coalesce(s.n, c.n)) AS BIGINT) AS n
FROM s FULL JOIN c USING (id_hogar) WHERE s.n IS NULL OR c.n IS NULL GROUP BY 1"""))
def unmatched(spark, sf):
    # Households of the first quarter against those of the second: each side has some that the other lacks.
    found = unmatched_cells(base(spark, sf, ["T2"]), base(spark, sf, ["T1"]), ["id_hogar"])
    return found.groupBy("side").agg(F.count("*").alias("celdas"), F.sum("n").alias("n"))


MONTHLY_CONTROLS = """, mensual AS (
  SELECT estrato AS term, CAST((substr(trimestre, 2, 1)::INTEGER - 1) * 3 + substr(mes_trimestre, 2, 1)::INTEGER AS INTEGER) AS mes,
         sum(fep) AS total FROM base GROUP BY 1, 2)
"""


def _monthly_controls(spark, sf):
    return base(spark, sf).groupBy(F.col("estrato").alias("term"), month_index().alias("mes")).agg(
        F.sum("fep").alias("total")
    )


@query("i11_controls_middle_month", sql("SELECT term, total FROM mensual WHERE mes = 6", MONTHLY_CONTROLS))
def controls_middle_month(spark, sf):
    return pick_controls(_monthly_controls(spark, sf), "middle")


@query("i11_controls_mean_of_months", sql("SELECT term, avg(total) AS total FROM mensual GROUP BY 1", MONTHLY_CONTROLS))
def controls_mean_of_months(spark, sf):
    return pick_controls(_monthly_controls(spark, sf), "mean")


@query("i12_recalibrate_accumulated", sql(
    """
SELECT trimestre, estrato, round(sum(dk_mes * t_per / s), 2) AS total, round(any_value(t_per / s), 9) AS g
FROM ajus a JOIN metas USING (estrato)
JOIN (SELECT trimestre, estrato, sum(dk_mes) AS s FROM ajus GROUP BY 1, 2) USING (trimestre, estrato) GROUP BY 1, 2""",
    QUARTERLY,
    TARGETS,
))
def recalibrate_accumulated(spark, sf):
    goals = quarterly_plan.household_targets(controls(spark, sf), "N_personas")
    out = poststratify(quarterly(spark, sf), "dk_mes", goals, "total", ["estrato"], ["trimestre"], "w")
    sums = out.groupBy("trimestre", "estrato").agg(F.sum("w").alias("total"), F.max(F.col("w") / F.col("dk_mes")).alias("g"))
    return rounded(sums, total=2, g=9)


def _before_after_sql(w: str) -> str:
    return f"""SELECT '{w}' AS peso, round(min({w}), 6) AS min, round(quantile_cont({w}, 0.5), 6) AS median,
      round(avg({w}), 6) AS mean, round(max({w}), 6) AS max FROM hogcal"""


@query("i13_weights_before_and_after", sql(
    f"{_before_after_sql('dk_mes')} UNION ALL {_before_after_sql('dk_mes_cali')}", QUARTERLY_CAL
))
def before_and_after(spark, sf):
    homes = quarterly_plan.calibrated_households(quarterly(spark, sf), controls(spark, sf))
    both = homes.select(
        F.explode(
            F.array(*[F.struct(F.lit(w).alias("peso"), F.col(w).alias("w")) for w in ("dk_mes", "dk_mes_cali")])
        ).alias("e")
    ).select("e.*")
    summary = weight_summary(both, "w", ["peso"]).drop("q1", "q3")
    return rounded(summary, min=6, median=6, mean=6, max=6)
