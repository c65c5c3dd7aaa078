"""Window-type operators, wide and long forms, sorts and unions."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import PANEL, PANEL_FINAL, QUARTERLY, QUARTERLY_CAL, base, controls, quarterly, rounded, sql, variance
from rotapanel.catalog.registry import query
from rotapanel.functions.recode import in_labour_force, label, unemployed
from rotapanel.functions.reshape import to_wide
from rotapanel.operators.flows import flow_table, flow_totals, flow_weights, total_with_error
from rotapanel.operators.longitudinal import PERSON, wide_states
from rotapanel.operators.overlap import periods_of, seen_in_all, shared_units
from rotapanel.operators.weights import moving_quarters, pool_rounds, quarter_factors, size_shares, year_factors
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.microdata import MONTHS, NO_ANSWER, POVERTY_LABELS


@query("e1_partition_total", sql("SELECT trimestre, mes_trimestre, num, den, ai FROM fac", QUARTERLY))
def partition_total(spark, sf):
    return quarter_factors(base(spark, sf))


@query("e2_overall_total", sql("""
SELECT trimestre, mes_trimestre, sum(fep) AS num, sum(sum(fep)) OVER () AS den, sum(fep) / sum(sum(fep)) OVER () AS bi
FROM base GROUP BY 1, 2"""))
def overall_total(spark, sf):
    return year_factors(base(spark, sf))


def _share_sql(within: str) -> str:
    return f"""
SELECT estrato, trimestre, mes_trimestre, count(*) AS n_th,
       count(*) / sum(count(*)) OVER (PARTITION BY estrato{within}) AS delta FROM base GROUP BY 1, 2, 3"""


@query("e3_sample_share_quarter", sql(_share_sql(", trimestre")))
def sample_share_quarter(spark, sf):
    return size_shares(base(spark, sf))


@query("e3_sample_share_year", sql(_share_sql("")))
def sample_share_year(spark, sf):
    return size_shares(base(spark, sf), within=[])


@query("e4_moving_quarter", sql("""
, meses AS (
  SELECT CAST((substr(trimestre, 2, 1)::INTEGER - 1) * 3 + substr(mes_trimestre, 2, 1)::INTEGER AS INTEGER) AS mes,
         sum(fep * CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END) AS y,
         sum(fep * CASE WHEN trabajo <> 'Inactivo' THEN 1 ELSE 0 END) AS z
  FROM base WHERE trabajo IS NOT NULL GROUP BY 1)
SELECT e.mes AS mes_fin, sum(m.y) AS y, sum(m.z) AS z, round(sum(m.y) / sum(m.z), 9) AS theta
FROM meses e JOIN meses m ON m.mes BETWEEN e.mes - 2 AND e.mes WHERE e.mes >= 3 GROUP BY 1"""))
def moving_quarter(spark, sf):
    known = base(spark, sf).where(F.col("trabajo").isNotNull())
    w = F.col("fep")
    sums = moving_quarters(known, {"y": w * unemployed(), "z": w * in_labour_force()})
    return rounded(sums.withColumn("theta", F.try_divide("y", "z")), theta=9)


@query("f1_wide_with_default", sql("""
SELECT trimestre, count(DISTINCT upm) FILTER (mes_trimestre = 'M1') AS M1,
       count(DISTINCT upm) FILTER (mes_trimestre = 'M2') AS M2, count(DISTINCT upm) FILTER (mes_trimestre = 'M3') AS M3
FROM base GROUP BY 1"""))
def wide_with_default(spark, sf):
    units = base(spark, sf).select("trimestre", "mes_trimestre", "upm").distinct()
    counts = units.groupBy("trimestre", "mes_trimestre").agg(F.count(F.lit(1)).alias("n"))
    return to_wide(counts, ["trimestre"], "mes_trimestre", F.sum("n"), MONTHS, fill=0)


@query("f2_wide_states", sql("""
SELECT id_hogar, id_pers, max(trabajo) FILTER (trimestre = 'T1') AS trabajo_t1,
       max(trabajo) FILTER (trimestre = 'T2') AS trabajo_t2 FROM base WHERE trimestre IN ('T1', 'T2') GROUP BY 1, 2"""))
def wide_of_states(spark, sf):
    return wide_states(base(spark, sf, ["T1", "T2"]), "trabajo", ["T1", "T2"])


def _final(spark, sf):
    scored = panel_plan.scored_panel(base(spark, sf), 0.75)
    return panel_plan.final_base(scored, controls(spark, sf), "pobreza")


def _label_sql(c: str) -> str:
    return (
        f"CASE {c} WHEN 1 THEN 'Pobreza extrema' WHEN 2 THEN 'Pobreza no extrema' "
        "WHEN 3 THEN 'Fuera de la pobreza' ELSE 'No responde' END"
    )


STATES = [*POVERTY_LABELS.values(), NO_ANSWER]


@query("f3_wide_text_cells", sql(
    f"""
, celdas AS (
  SELECT {_label_sql('a.pobreza_t1')} AS pobreza_t1, {_label_sql('a.pobreza_t2')} AS p2,
         CAST(round_even(t, 0) AS BIGINT) || ' (' || CAST(round_even(sqrt(v), 0) AS BIGINT) || ')' AS texto
  FROM (SELECT pobreza_t1, pobreza_t2, sum(fex_cali) AS t FROM final GROUP BY 1, 2) a
  JOIN vf b ON a.pobreza_t1 IS NOT DISTINCT FROM b.pobreza_t1 AND a.pobreza_t2 IS NOT DISTINCT FROM b.pobreza_t2)
SELECT pobreza_t1, {", ".join(f"coalesce(max(texto) FILTER (p2 = '{s}'), '0 (0)') AS " + chr(34) + s + chr(34) for s in STATES)}
FROM celdas GROUP BY 1""",
    PANEL_FINAL,
    variance("final", ["pobreza_t1", "pobreza_t2"], "fex_cali", name="vf"),
))
def wide_text_cells(spark, sf):
    totals = flow_totals(panel_plan.panel_design(_final(spark, sf)), "pobreza_t1", "pobreza_t2")
    cells = totals.select(
        label("pobreza_t1", POVERTY_LABELS, NO_ANSWER).alias("pobreza_t1"),
        label("pobreza_t2", POVERTY_LABELS, NO_ANSWER).alias("pobreza_t2"),
        total_with_error().alias("texto"),
    )
    return to_wide(cells, ["pobreza_t1"], "pobreza_t2", F.first("texto"), STATES, fill="0 (0)")


@query("f4_wide_with_prefix", sql("""
SELECT id_hogar, max(trabajo) FILTER (trimestre = 'T1') AS trabajo_T1, max(trabajo) FILTER (trimestre = 'T2') AS trabajo_T2
FROM base WHERE trimestre IN ('T1', 'T2') AND id_pers = 1 GROUP BY 1"""))
def wide_with_prefix(spark, sf):
    firsts = base(spark, sf, ["T1", "T2"]).where(F.col("id_pers") == 1)
    return to_wide(firsts, ["id_hogar"], "trimestre", F.first("trabajo"), ["T1", "T2"], prefix="trabajo_")


@query("f5_unnest_list", sql("""
SELECT upm, trimestre, CAST(row_number() OVER (PARTITION BY upm ORDER BY trimestre) AS INTEGER) AS lugar,
       min(trimestre) OVER (PARTITION BY upm) AS primero
FROM (SELECT DISTINCT upm, trimestre FROM base)"""))
def unnest_list(spark, sf):
    lists = periods_of(base(spark, sf), ["upm"])
    rows = lists.select("upm", F.element_at("periodos", 1).alias("primero"), F.posexplode("periodos").alias("pos", "trimestre"))
    return rows.select("upm", "trimestre", (F.col("pos") + 1).alias("lugar"), "primero")


@query("f6_sorted_pairs", sql("""
SELECT a.trimestre AS trimestre_1, b.trimestre AS trimestre_2, count(*) AS traslape
FROM (SELECT DISTINCT upm, trimestre FROM base) a JOIN (SELECT DISTINCT upm, trimestre FROM base) b
  ON a.upm = b.upm AND a.trimestre < b.trimestre GROUP BY 1, 2 ORDER BY 1, 2"""))
def sorted_pairs(spark, sf):
    return shared_units(base(spark, sf), ["upm"]).orderBy("trimestre_1", "trimestre_2")


@query("f7_limit", sql("""
SELECT id_hogar, id_pers, trimestre, fep_long, respboth_per FROM gente
ORDER BY id_hogar, id_pers, trimestre LIMIT 8""", PANEL))
def limited(spark, sf):
    from rotapanel.operators.longitudinal import person_panel

    people = person_panel(base(spark, sf), "T1", "T2", 0.75)
    return people.select(*PERSON, "trimestre", "fep_long", "respboth_per").orderBy(*PERSON, "trimestre").limit(8)


@query("f8_union_same_columns", sql("""
SELECT trimestre, mes_trimestre, upm, id_hogar, round(dk_mes_cali, 6) AS dk_mes_cali FROM hogcal""", QUARTERLY_CAL))
def union_same_columns(spark, sf):
    homes = quarterly_plan.calibrated_households(quarterly(spark, sf), controls(spark, sf)).select(
        *quarterly_plan.HOME, "dk_mes_cali"
    )
    parts = [homes.where(F.col("trimestre") == q) for q in ("T1", "T2", "T3", "T4")]
    return rounded(pool_rounds(parts, "dk_mes_cali").drop("w_pool"), dk_mes_cali=6)


FLOW_SQL = """
, celdas AS (SELECT pobreza_t1 AS a, pobreza_t2 AS b, {v} AS v FROM final GROUP BY 1, 2)
SELECT CAST(a AS VARCHAR) AS estado, coalesce(sum(v) FILTER (b = 1), 0)::{t} AS s_1, coalesce(sum(v) FILTER (b = 2), 0)::{t} AS s_2,
       coalesce(sum(v) FILTER (b = 3), 0)::{t} AS s_3, coalesce(sum(v) FILTER (b IS NULL), 0)::{t} AS complemento_fila
FROM celdas WHERE a IS NOT NULL GROUP BY 1
UNION ALL
SELECT 'Complemento columna', coalesce(sum(v) FILTER (b = 1), 0)::{t}, coalesce(sum(v) FILTER (b = 2), 0)::{t},
       coalesce(sum(v) FILTER (b = 3), 0)::{t}, coalesce(sum(v) FILTER ({corner}), 0)::{t} FROM celdas WHERE a IS NULL"""


@query("f9_union_missing_columns", sql(FLOW_SQL.format(v="count(*)", t="BIGINT", corner="b IS NOT NULL"), PANEL_FINAL))
def union_missing_columns(spark, sf):
    cells = flow_weights(_final(spark, sf), "pobreza_t1", "pobreza_t2", "fex_cali")
    return flow_table(cells, "n", [1, 2, 3], corner="column_sum")


@query("f10_intersection", sql("""
SELECT id_hogar, id_pers FROM base WHERE trimestre = 'T1' INTERSECT SELECT id_hogar, id_pers FROM base WHERE trimestre = 'T2'"""))
def intersection(spark, sf):
    return seen_in_all(base(spark, sf), PERSON, ["T1", "T2"])
