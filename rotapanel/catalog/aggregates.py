"""Aggregations and grouping."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import (
    ANNUAL, ANNUAL_CAL, PANEL, PANEL_FINAL, QUARTERLY, QUARTERLY_CAL, annual, base, controls, quarterly, rounded, sql,
    variance,
)
from rotapanel.catalog.registry import query
from rotapanel.functions.recode import in_labour_force, unemployed
from rotapanel.functions.reshape import to_wide
from rotapanel.operators.calibration import histogram, weight_summary
from rotapanel.operators.estimation import sum_over_months, survey_mean, survey_total, with_national
from rotapanel.operators.longitudinal import PERSON, household_panel, person_panel
from rotapanel.operators.overlap import periods_of
from rotapanel.operators.weights import mean_weight
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.microdata import ACTIVITY, MONTHS

def _n():
    return F.count(F.lit(1)).alias("n")


@query("d1_group_count", sql("SELECT trimestre, mes_trimestre, count(*) AS n FROM base GROUP BY 1, 2"))
def group_count(spark, sf):
    return base(spark, sf).groupBy("trimestre", "mes_trimestre").agg(_n())


@query("d2_distinct_count", sql("""
SELECT trimestre, count(DISTINCT upm) AS upm, count(DISTINCT id_hogar) AS hogares FROM base GROUP BY 1"""))
def distinct_count(spark, sf):
    homes = base(spark, sf).select("trimestre", "upm", "id_hogar").distinct()
    # A household belongs to one unit, so counting its rows counts households.
    per_unit = homes.groupBy("trimestre", "upm").agg(_n())
    return per_unit.groupBy("trimestre").agg(F.count(F.lit(1)).alias("upm"), F.sum("n").alias("hogares"))


@query("d3_having_count", sql("""
SELECT id_hogar, id_pers FROM base WHERE trimestre IN ('T1', 'T2') GROUP BY 1, 2
HAVING count(DISTINCT trimestre) = 2"""))
def having_count(spark, sf):
    seen = base(spark, sf, ["T1", "T2"]).select(*PERSON, "trimestre").distinct()
    return seen.groupBy(*PERSON).agg(_n()).where(F.col("n") == 2).select(*PERSON)


@query("d4_weighted_sum", sql("""
SELECT trimestre, mes_trimestre, sum(fep) AS num FROM base GROUP BY 1, 2"""))
def weighted_sum(spark, sf):
    return base(spark, sf).groupBy("trimestre", "mes_trimestre").agg(F.sum("fep").alias("num"))


@query("d5_global_sum", sql("SELECT sum(fep_long) AS total FROM hogpanel", PANEL.replace("0.75", "0.5")))
def global_sum(spark, sf):
    panel = household_panel(base(spark, sf), "T1", "T2")
    long = F.when(F.col("respboth") == 1, F.col("fep_t1") / 0.5).otherwise(0.0)
    return panel.agg(F.sum(long).alias("total"))


def _activity(src: str, w: str, keys: str, group: str) -> str:
    cols = ", ".join(f"round(coalesce(sum({w}) FILTER (trabajo = '{a}'), 0), 2) AS {a}" for a in ACTIVITY)
    return f"SELECT {keys}{cols} FROM {src} WHERE trabajo IS NOT NULL {group}"


@query("d6_weighted_sum_by_state_quarterly", sql(_activity("ajus", "dk_mes", "trimestre, ", "GROUP BY 1"), QUARTERLY))
def by_state_quarterly(spark, sf):
    known = quarterly(spark, sf).where(F.col("trabajo").isNotNull())
    sums = known.groupBy("trimestre", "trabajo").agg(F.sum("dk_mes").alias("w"))
    wide = to_wide(sums, ["trimestre"], "trabajo", F.sum("w"), ACTIVITY, fill=0.0)
    return rounded(wide, **dict.fromkeys(ACTIVITY, 2))


@query("d6_weighted_sum_by_state_annual", sql(_activity("ajus2", "dk_anual", "", ""), ANNUAL))
def by_state_annual(spark, sf):
    known = annual(spark, sf).where(F.col("trabajo").isNotNull())
    sums = known.groupBy("trabajo").agg(F.sum("dk_anual").alias("w"))
    wide = to_wide(sums.withColumn("_", F.lit(1)), ["_"], "trabajo", F.sum("w"), ACTIVITY, fill=0.0).drop("_")
    return rounded(wide, **dict.fromkeys(ACTIVITY, 2))


def _rate_sql(src: str, w: str, keys: str = "") -> str:
    y, z = (f"CASE WHEN trabajo {c} THEN 1 ELSE 0 END" for c in ("= 'Desocupado'", "<> 'Inactivo'"))
    return f"""
SELECT {keys} round(sum({w} * {y}), 2) AS tot_yk, round(sum({w} * {z}), 2) AS tot_zk,
       round(sum({w} * {y}) / sum({w} * {z}), 6) AS theta
FROM {src} WHERE trabajo IS NOT NULL {"GROUP BY 1" if keys else ""}"""


def _rate(df, w: str, *by: str):
    known = df.where(F.col("trabajo").isNotNull())
    sums = known.groupBy(*by).agg(
        F.sum(F.col(w) * unemployed()).alias("tot_yk"), F.sum(F.col(w) * in_labour_force()).alias("tot_zk")
    )
    return rounded(
        sums.withColumn("theta", F.try_divide("tot_yk", "tot_zk")), tot_yk=2, tot_zk=2, theta=6
    )


@query("d7_unemployment_rate_quarterly", sql(_rate_sql("ajus", "dk_mes", "trimestre,"), QUARTERLY))
def unemployment_quarterly(spark, sf):
    return _rate(quarterly(spark, sf), "dk_mes", "trimestre")


@query("d7_unemployment_rate_annual", sql(_rate_sql("ajus2", "dk_anual"), ANNUAL))
def unemployment_annual(spark, sf):
    return _rate(annual(spark, sf), "dk_anual")


def _mean_sql(keys: list[str], pivot: str, levels: list) -> str:
    names = ", ".join(
        f"round(coalesce(sum(w) FILTER (k = '{x}') / sum(n) FILTER (k = '{x}'), 0), 6) AS \"{x}\"" for x in levels
    )
    group = ", ".join(keys)
    return f"""
SELECT {group}, {names} FROM (
  SELECT {group}, coalesce({pivot}, 'null') AS k, sum(dk_mes_cali) AS w, count(*) AS n FROM cali GROUP BY ALL)
GROUP BY ALL"""


def _mean_weights(spark, sf, by: list[str], keys: list[str], pivot: str, levels: list):
    people = quarterly_plan.calibrated_persons(base(spark, sf), controls(spark, sf))
    means = mean_weight(people, "dk_mes_cali", by)
    named = means.withColumn(pivot, F.coalesce(pivot, F.lit("null")))
    wide = to_wide(named, keys, pivot, F.first("prop"), levels, fill=0.0)
    return rounded(wide, **dict.fromkeys(levels, 6))


@query("d8_mean_weight_national", sql(_mean_sql(["trimestre"], "mes_trimestre", MONTHS), QUARTERLY_CAL))
def mean_weight_national(spark, sf):
    return _mean_weights(spark, sf, [], ["trimestre"], "mes_trimestre", MONTHS)


@query("d9_mean_weight_by_sex", sql(_mean_sql(["trimestre", "sexo"], "mes_trimestre", MONTHS), QUARTERLY_CAL))
def mean_weight_by_sex(spark, sf):
    return _mean_weights(spark, sf, ["sexo"], ["trimestre", "sexo"], "mes_trimestre", MONTHS)


@query(
    "d10_mean_weight_by_activity",
    sql(_mean_sql(["trimestre", "mes_trimestre"], "trabajo", [*ACTIVITY, "null"]), QUARTERLY_CAL),
)
def mean_weight_by_activity(spark, sf):
    return _mean_weights(spark, sf, ["trabajo"], ["trimestre", "mes_trimestre"], "trabajo", [*ACTIVITY, "null"])


@query(
    "d11_mean_weight_by_area_and_sex",
    sql(_mean_sql(["trimestre", "area", "sexo"], "mes_trimestre", MONTHS), QUARTERLY_CAL),
)
def mean_weight_by_area_and_sex(spark, sf):
    return _mean_weights(spark, sf, ["area", "sexo"], ["trimestre", "area", "sexo"], "mes_trimestre", MONTHS)


@query("d12_rollup_with_total", sql(
    """
SELECT coalesce(area, 'Nacional') AS area, round(t, 2) AS total, round(sqrt(greatest(v, 0)), 1) AS se FROM (
  SELECT f.area, t, v FROM (SELECT area, sum(fex_cali) AS t FROM final GROUP BY ROLLUP (area)) f
  JOIN (SELECT area, v FROM v_area UNION ALL SELECT NULL, v FROM v_all) x ON f.area IS NOT DISTINCT FROM x.area)""",
    PANEL_FINAL,
    variance("final", ["area"], "fex_cali", name="v_area"),
    variance("final", [], "fex_cali", name="v_all"),
))
def rollup_with_total(spark, sf):
    scored = panel_plan.scored_panel(base(spark, sf), 0.75)
    final = panel_plan.final_base(scored, controls(spark, sf), "pobreza")
    out = with_national(panel_plan.panel_design(final), "area")
    return rounded(out.select("area", "total", "se"), total=2, se=1)


@query("d13_sorted_unique_list", sql("""
SELECT upm, string_agg(trimestre, ',' ORDER BY trimestre) AS trimestres
FROM (SELECT DISTINCT upm, trimestre FROM base) GROUP BY 1"""))
def sorted_unique_list(spark, sf):
    return periods_of(base(spark, sf), ["upm"]).select("upm", F.array_join("periodos", ",").alias("trimestres"))


@query("d14_distinct_units_in_estimate", sql("""
SELECT estrato, count(DISTINCT upm) AS n_upm, round(sum(fex_cali), 2) AS total FROM final GROUP BY 1""", PANEL_FINAL))
def distinct_units(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    units = final.groupBy("estrato", "upm").agg(F.sum("fex_cali").alias("w"))
    return units.groupBy("estrato").agg(F.count(F.lit(1)).alias("n_upm"), F.round(F.sum("w"), 2).alias("total"))


@query("d15_crosstab_with_missing", sql("""
SELECT trimestre, pobreza, count(*) AS n FROM base WHERE trimestre IN ('T1', 'T2') GROUP BY 1, 2"""))
def crosstab(spark, sf):
    return base(spark, sf, ["T1", "T2"]).groupBy("trimestre", "pobreza").agg(_n())


@query("d16_frequency", sql("SELECT respboth_per, count(*) AS n FROM gente GROUP BY 1", PANEL))
def frequency(spark, sf):
    return person_panel(base(spark, sf), "T1", "T2", 0.75).groupBy("respboth_per").agg(_n())


def _summary_sql(src: str, w: str, by: str = "") -> str:
    q = ", ".join(
        f"round(quantile_cont({w}, {p}), 6) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return f"""
SELECT {by}round(min({w}), 6) AS min, {q}, round(avg({w}), 6) AS mean, round(max({w}), 6) AS max
FROM {src} {"GROUP BY ALL" if by else ""}"""


SUMMARY = dict.fromkeys(["min", "q1", "median", "mean", "q3", "max"], 6)


@query("d17_weight_summary", sql(_summary_sql("hogcal", "dk_mes_cali", "trimestre, "), QUARTERLY_CAL))
def summary_of_weights(spark, sf):
    homes = quarterly_plan.calibrated_households(quarterly(spark, sf), controls(spark, sf))
    return rounded(weight_summary(homes, "dk_mes_cali", ["trimestre"]), **SUMMARY)


@query("d18_conditional_count", sql("""
SELECT count(*) FILTER (dk_anual_calib < 30) AS bajo_30, count(*) FILTER (dk_anual_calib < 1) AS bajo_1
FROM hogcal2""", ANNUAL_CAL))
def conditional_count(spark, sf):
    homes = annual_plan.calibrated_households(annual(spark, sf), controls(spark, sf))
    return homes.agg(
        F.count_if(F.col("dk_anual_calib") < 30).alias("bajo_30"), F.count_if(F.col("dk_anual_calib") < 1).alias("bajo_1")
    )


@query("d19_histogram", sql("""
SELECT CAST(least(floor((fep - lo) / ((hi - lo) / 100)) + 1, 100) AS BIGINT) AS bin, count(*) AS n
FROM base, (SELECT min(fep) AS lo, max(fep) AS hi FROM base) GROUP BY 1"""))
def histogram_of_weights(spark, sf):
    return histogram(base(spark, sf), "fep", 100)


@query("d20_mean_of_period_estimates", sql("""
SELECT round(avg(media), 4) AS media FROM (
  SELECT trimestre, sum(dk_mes_cali * ingreso) / sum(dk_mes_cali) AS media FROM cali
  WHERE trimestre IN ('T1', 'T2', 'T3') GROUP BY 1)""", QUARTERLY_CAL))
def mean_of_estimates(spark, sf):
    design = quarterly_plan.quarterly_design(base(spark, sf), controls(spark, sf), ["T1", "T2", "T3"])
    means = survey_mean(design, F.col("ingreso"), ["trimestre"], "media")
    return means.agg(F.round(F.avg("media"), 4).alias("media"))


T1_CALI = ", t1 AS (SELECT * FROM cali WHERE trimestre = 'T1')"


@query("d21_aggregate_of_estimates", sql(
    """
SELECT trabajo, round(sum(t), 2) AS total_trim, round(sqrt(sum(v)), 2) AS se_trim
FROM (SELECT mes_trimestre, trabajo, sum(dk_mes_cali) AS t FROM t1 WHERE trabajo IS NOT NULL GROUP BY 1, 2)
JOIN ve USING (mes_trimestre, trabajo) GROUP BY 1""",
    QUARTERLY_CAL,
    T1_CALI,
    variance("t1", ["mes_trimestre", "trabajo"], "dk_mes_cali", "trabajo IS NOT NULL", "ve"),
))
def aggregate_of_estimates(spark, sf):
    design = quarterly_plan.quarterly_design(base(spark, sf), controls(spark, sf), ["T1"])
    monthly = survey_total(design.where(F.col("trabajo").isNotNull()), ["mes_trimestre", "trabajo"])
    return rounded(sum_over_months(monthly, ["trabajo"]), total_trim=2, se_trim=2)


@query("d22_household_size", sql("""
SELECT trimestre, mes_trimestre, estrato, upm, id_hogar, count(*) AS n_personas FROM base GROUP BY ALL"""))
def household_size(spark, sf):
    keys = ["trimestre", "mes_trimestre", "estrato", "upm", "id_hogar"]
    return base(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_personas"))
