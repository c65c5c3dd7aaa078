"""Scans and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import TARGETS, PANEL_FINAL, base, controls, scratch, sql
from rotapanel.catalog.registry import query
from rotapanel.plans.panel import final_base, reload_final, scored_panel, store_final
from rotapanel.sources.controls import control_terms, inline_controls, read_controls, write_controls_csv
from rotapanel.sources.microdata import contract_violations


@query("a1_scan_microdata", sql("SELECT * FROM base"))
def scan_microdata(spark, sf):
    return base(spark, sf)


@query("a1_contract_check", sql("""
SELECT r.rule, CAST(0 AS BIGINT) AS broken FROM (VALUES ('missing_key_or_weight'), ('unknown_period'),
  ('household_in_two_months'), ('household_with_two_weights'), ('person_twice_in_quarter')) r(rule)"""))
def contract(spark, sf):
    return contract_violations(base(spark, sf))


@query("a2_scan_two_quarters", sql("SELECT * FROM base WHERE trimestre IN ('T1', 'T2')"))
def scan_two_quarters(spark, sf):
    return base(spark, sf, ["T1", "T2"])


@query("a3_scan_controls", sql("SELECT dam, area, N_hogares, N_personas FROM poblacion"))
def scan_controls(spark, sf):
    path = write_controls_csv(controls(spark, sf), scratch(spark, sf, "poblacion_csv"))
    return read_controls(spark, path)


@query("a4_inline_controls", sql("""
SELECT b.area, sum(fep) AS n_hat, any_value(t.total) AS total
FROM base b JOIN (VALUES ('1', 1076892.0::DOUBLE), ('2', 162876.0::DOUBLE)) t(area, total) ON b.area = t.area
GROUP BY 1"""))
def inline(spark, sf):
    # Totals stated in the program.
    totals = inline_controls(spark, {"1": 1076892, "2": 162876}).withColumnRenamed("term", "area")
    sums = base(spark, sf).groupBy("area").agg(F.sum("fep").alias("n_hat"))
    return sums.join(totals, "area")


@query("a5_rescan_longitudinal_base", sql("""
SELECT estrato, count(*) AS n, round(sum(fex_cali), 2) AS total FROM final GROUP BY 1""", PANEL_FINAL))
def rescan(spark, sf):
    path = scratch(spark, sf, "base_personas_trim_a5")
    store_final(final_base(scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza"), path)
    stored = reload_final(spark, path)
    return stored.groupBy("estrato").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("fex_cali"), 2).alias("total")
    )


@query("a6_write_longitudinal_base", sql("""
SELECT id_hogar, id_pers, upm, estrato, edad, sexo, area, round(fep_aj, 6) AS fep_aj,
       pobreza_t1, pobreza_t2, round(fex_cali, 6) AS fex_cali FROM final""", PANEL_FINAL))
def write_final(spark, sf):
    final = final_base(scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    stored = store_final(final, scratch(spark, sf, "base_personas_trim"))
    return stored.withColumns({c: F.round(c, 6) for c in ("fep_aj", "fex_cali")})


@query("a7_preview", sql("""
SELECT upm, trimestre, id_hogar, fep FROM (SELECT DISTINCT upm, trimestre, id_hogar, fep FROM base)
ORDER BY id_hogar, trimestre LIMIT 10"""))
def preview(spark, sf):
    rows = base(spark, sf).select("upm", "trimestre", "id_hogar", "fep").distinct()
    return rows.orderBy("id_hogar", "trimestre").limit(10)


@query("a3_control_terms", sql("SELECT 'hh_' || estrato AS term, t_hog AS total FROM metas", TARGETS))
def terms(spark, sf):
    return control_terms(controls(spark, sf), "N_hogares", "hh_")
