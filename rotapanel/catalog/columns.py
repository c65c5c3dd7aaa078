"""Projections, filters, recodes and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import (
    ANNUAL, ANNUAL_CAL, PANEL, PANEL_FINAL, QUARTERLY, TARGETS, annual, base, controls, quarterly, rounded,
    sql,
)
from rotapanel.catalog.registry import query
from rotapanel.functions.recode import hash_draw, in_labour_force, inverse_logit, joined, label, level_order, masked, unemployed
from rotapanel.functions.reshape import (
    complete_grid, dummies_long, dummies_wide, rename_matching, scale_matching, to_wide, with_total,
)
from rotapanel.operators.longitudinal import PERSON, households, household_panel
from rotapanel.operators.overlap import seen_in_all
from rotapanel.operators.weights import mean_weight, quarter_factors
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.microdata import NO_ANSWER, POVERTY_LABELS

STRATA = [f"{d}_{a}" for d in range(5) for a in (1, 2)]


@query("b1_select_renamed", sql("""
SELECT DISTINCT id_hogar, fep AS fep_t1 FROM base WHERE trimestre = 'T1'"""))
def select_renamed(spark, sf):
    homes = households(base(spark, sf, ["T1"]))
    return homes.select("id_hogar", F.col("fep").alias("fep_t1"))


@query("b2_drop_columns", sql("SELECT trimestre, mes_trimestre, ai FROM fac", QUARTERLY))
def drop_columns(spark, sf):
    return quarter_factors(base(spark, sf)).drop("num", "den")


@query("b3_derived_column", sql("SELECT id_hogar, id_pers, trimestre, fep * ai AS dk_mes FROM ajus", QUARTERLY))
def derived_column(spark, sf):
    return quarterly(spark, sf).select(*PERSON, "trimestre", "dk_mes")


@query("b4_project_and_derive", sql("""
SELECT trimestre, mes_trimestre, round(sum(dk_mes) / count(*), 6) AS prop FROM ajus GROUP BY 1, 2""", QUARTERLY))
def project_and_derive(spark, sf):
    means = mean_weight(quarterly(spark, sf), "dk_mes")
    return means.select("trimestre", "mes_trimestre", F.round("prop", 6).alias("prop"))


@query("b5_rename", sql("""
SELECT id_hogar, id_pers, max(pobreza) FILTER (trimestre = 'T1') AS pobreza_t1,
       max(pobreza) FILTER (trimestre = 'T2') AS pobreza_t2
FROM base WHERE trimestre IN ('T1', 'T2') GROUP BY 1, 2"""))
def rename(spark, sf):
    wide = to_wide(base(spark, sf, ["T1", "T2"]), PERSON, "trimestre", F.max("pobreza"), ["T1", "T2"])
    return wide.withColumnsRenamed({"T1": "pobreza_t1", "T2": "pobreza_t2"})


def _dummy_sql(prefix: str, value: str = "1") -> str:
    return ", ".join(f"CASE WHEN estrato = '{s}' THEN {value} ELSE 0 END AS {prefix}{s}" for s in STRATA)


@query("b6_regex_rename", sql(f"""
SELECT trimestre, id_hogar, {_dummy_sql('hh_')} FROM base WHERE id_pers = 1"""))
def regex_rename(spark, sf):
    homes = base(spark, sf).where(F.col("id_pers") == 1).select("trimestre", "id_hogar", "estrato")
    wide = dummies_wide(homes, "estrato", STRATA, "estrato_hh_").drop("estrato")
    return rename_matching(wide, r"^estrato_", "")


@query("b7_filter_equal", sql("SELECT * FROM base WHERE id_pers = 1 AND trimestre = 'T1'"))
def filter_equal(spark, sf):
    return base(spark, sf).where((F.col("id_pers") == 1) & (F.col("trimestre") == "T1"))


@query("b8_filter_in_set", sql("""
SELECT trimestre, count(*) AS n FROM base WHERE trimestre IN ('T1', 'T2', 'T3') GROUP BY 1"""))
def filter_in_set(spark, sf):
    kept = base(spark, sf).where(F.col("trimestre").isin("T2", "T1", "T3"))
    return kept.groupBy("trimestre").agg(F.count(F.lit(1)).alias("n"))


@query("b9_filter_not_null", sql("SELECT * FROM base WHERE trabajo IS NOT NULL"))
def filter_not_null(spark, sf):
    return base(spark, sf).where(F.col("trabajo").isNotNull())


@query("b9_filter_null_pair", sql("""
SELECT pobreza_t1, count(*) AS n FROM panel WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NULL GROUP BY 1""",
    PANEL_FINAL))
def filter_null_pair(spark, sf):
    final = _final(spark, sf)
    return final.where("pobreza_t1 is not null and pobreza_t2 is null").groupBy("pobreza_t1").agg(
        F.count(F.lit(1)).alias("n")
    )


def _final(spark, sf):
    scored = panel_plan.scored_panel(base(spark, sf), 0.75)
    return panel_plan.final_base(scored, controls(spark, sf), "pobreza")


@query("b10_membership_flag", sql("""
SELECT h.*, CASE WHEN h.id_hogar IN (SELECT id_hogar FROM ambos) THEN 1 ELSE 0 END AS respboth FROM hogares h""",
    PANEL))
def membership_flag(spark, sf):
    people = base(spark, sf, ["T1", "T2"])
    both = seen_in_all(people, ["id_hogar"], ["T1", "T2"]).withColumn("respboth", F.lit(1))
    flagged = households(people).join(both, "id_hogar", "left")
    return flagged.withColumn("respboth", F.coalesce("respboth", F.lit(0)))


@query("b11_membership_filter", sql("""
SELECT * FROM base WHERE trimestre IN ('T1', 'T2') AND id_hogar IN (SELECT id_hogar FROM ambos)""", PANEL))
def membership_filter(spark, sf):
    people = base(spark, sf, ["T1", "T2"])
    return people.join(seen_in_all(people, ["id_hogar"], ["T1", "T2"]), "id_hogar", "left_semi")


@query("b12_binary_indicators", sql("""
SELECT id_hogar, id_pers, trimestre, CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END AS yk,
       CASE WHEN trabajo <> 'Inactivo' THEN 1 ELSE 0 END AS zk
FROM base WHERE trabajo IS NOT NULL"""))
def binary_indicators(spark, sf):
    people = base(spark, sf).where(F.col("trabajo").isNotNull())
    return people.select(*PERSON, "trimestre", unemployed().alias("yk"), in_labour_force().alias("zk"))


@query("b13_recode_with_default", sql("""
SELECT CASE pobreza WHEN 1 THEN 'Pobreza extrema' WHEN 2 THEN 'Pobreza no extrema'
       WHEN 3 THEN 'Fuera de la pobreza' ELSE 'No responde' END AS estado, count(*) AS n FROM base GROUP BY 1"""))
def recode_with_default(spark, sf):
    state = label("pobreza", POVERTY_LABELS, NO_ANSWER)
    return base(spark, sf).groupBy(state.alias("estado")).agg(F.count(F.lit(1)).alias("n"))


@query("b13_recode_without_default", sql("""
SELECT CASE pobreza WHEN 1 THEN 'Pobreza extrema' WHEN 2 THEN 'Pobreza no extrema'
       WHEN 3 THEN 'Fuera de la pobreza' END AS estado, count(*) AS n FROM base GROUP BY 1"""))
def recode_without_default(spark, sf):
    return base(spark, sf).groupBy(label("pobreza", POVERTY_LABELS).alias("estado")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("b14_ordered_factor", sql("""
SELECT CASE pobreza WHEN 1 THEN 'Pobreza extrema' WHEN 2 THEN 'Pobreza no extrema'
       WHEN 3 THEN 'Fuera de la pobreza' END AS estado, CAST(pobreza AS BIGINT) AS orden, sum(fep) AS w
FROM base WHERE pobreza IS NOT NULL GROUP BY 1, 2"""))
def ordered_factor(spark, sf):
    known = base(spark, sf).where(F.col("pobreza").isNotNull())
    named = known.select(label("pobreza", POVERTY_LABELS).alias("estado"), "fep")
    order = level_order("estado", list(POVERTY_LABELS.values())).cast("long")
    return named.groupBy("estado", order.alias("orden")).agg(F.sum("fep").alias("w"))


@query("b15_labelled_to_factor", sql("""
SELECT id_hogar, id_pers, trimestre, CASE pobreza WHEN 1 THEN 'Pobreza extrema' WHEN 2 THEN 'Pobreza no extrema'
       WHEN 3 THEN 'Fuera de la pobreza' END AS pobreza FROM base"""))
def labelled_to_factor(spark, sf):
    return base(spark, sf).select(*PERSON, "trimestre", label("pobreza", POVERTY_LABELS).alias("pobreza"))


@query("b16_one_hot_long", sql("""
SELECT estrato AS term, sum(1.0::DOUBLE) AS x, sum(fep) AS w FROM base WHERE id_pers = 1 GROUP BY 1"""))
def one_hot_long(spark, sf):
    homes = base(spark, sf).where(F.col("id_pers") == 1)
    long = dummies_long(homes, ["trimestre", "id_hogar", "fep"], "estrato")
    return long.groupBy("term").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("fep")).alias("w"))


@query("b16_one_hot_wide", sql(f"""
SELECT trimestre, id_hogar, {_dummy_sql('estrato_')} FROM base WHERE id_pers = 1"""))
def one_hot_wide(spark, sf):
    homes = base(spark, sf).where(F.col("id_pers") == 1).select("trimestre", "id_hogar", "estrato")
    return dummies_wide(homes, "estrato", STRATA, "estrato_").drop("estrato")


@query("b17_across_matching", sql(f"""
SELECT trimestre, id_hogar, {_dummy_sql('hh_', 'n_personas')} FROM tam""", ANNUAL_CAL))
def across_matching(spark, sf):
    homes = annual_plan.household_sizes(annual(spark, sf)).select("trimestre", "id_hogar", "estrato", "n_personas")
    wide = dummies_wide(homes, "estrato", STRATA, "hh_")
    return scale_matching(wide, "hh_", F.col("n_personas")).drop("estrato", "n_personas")


@query("b18_sum_numeric_columns", sql("""
SELECT CAST(count(*) AS BIGINT) AS total FROM panel WHERE pobreza_t1 IS NULL AND pobreza_t2 IS NOT NULL""", PANEL_FINAL))
def sum_numeric(spark, sf):
    lost = _final(spark, sf).where("pobreza_t1 is null and pobreza_t2 is not null")
    return lost.groupBy("pobreza_t2").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )


@query("b19_row_total", sql("""
SELECT trimestre, count(*) FILTER (mes_trimestre = 'M1') AS M1, count(*) FILTER (mes_trimestre = 'M2') AS M2,
       count(*) FILTER (mes_trimestre = 'M3') AS M3, count(*) AS Total FROM base GROUP BY 1"""))
def row_total(spark, sf):
    counts = base(spark, sf).groupBy("trimestre", "mes_trimestre").agg(F.count(F.lit(1)).alias("n"))
    wide = to_wide(counts, ["trimestre"], "mes_trimestre", F.sum("n"), ["M1", "M2", "M3"], fill=0)
    return with_total(wide, ["M1", "M2", "M3"])


@query("b20_distinct", sql("SELECT DISTINCT trimestre, mes_trimestre, upm FROM base"))
def distinct_rows(spark, sf):
    return base(spark, sf).select("trimestre", "mes_trimestre", "upm").distinct()


@query("b21_complete_grid", sql("""
SELECT coalesce(g.a, p.pobreza_t1) AS pobreza_t1, coalesce(g.b, p.pobreza_t2) AS pobreza_t2, coalesce(n, 0) AS n
FROM (SELECT a, b FROM (VALUES (1), (2), (3)) x(a) CROSS JOIN (VALUES (1), (2), (3)) y(b)) g
FULL OUTER JOIN (SELECT pobreza_t1, pobreza_t2, count(*) AS n FROM panel GROUP BY 1, 2) p
  ON g.a = p.pobreza_t1 AND g.b = p.pobreza_t2""", PANEL_FINAL))
def complete(spark, sf):
    counts = _final(spark, sf).groupBy("pobreza_t1", "pobreza_t2").agg(
        F.count(F.lit(1)).alias("n")
    )
    return complete_grid(counts, {"pobreza_t1": [1, 2, 3], "pobreza_t2": [1, 2, 3]}, {"n": 0})


@query("b22_random_masking", sql("""
SELECT id_hogar, id_pers, trimestre,
       CASE WHEN ('0x' || substr(md5(id_hogar || ':' || id_pers || ':' || trimestre || ':15'), 1, 8))::BIGINT % 1000
                 >= CASE WHEN trimestre = 'T2' THEN 200 ELSE 100 END THEN pobreza END AS pobreza
FROM base WHERE trimestre IN ('T1', 'T2')"""))
def random_masking(spark, sf):
    people = base(spark, sf, ["T1", "T2"])
    rate = F.when(F.col("trimestre") == "T2", 0.2).otherwise(0.1)
    return people.select(*PERSON, "trimestre", masked("pobreza", [*PERSON, "trimestre"], rate, 15).alias("pobreza"))


@query("b23_id_set_and_size", sql("SELECT count(*) AS hogares_ambos FROM ambos", PANEL))
def id_set(spark, sf):
    ids = seen_in_all(base(spark, sf, ["T1", "T2"]), ["id_hogar"], ["T1", "T2"])
    return ids.agg(F.count(F.lit(1)).alias("hogares_ambos"))


@query("b24_attach_column", sql("""
SELECT id_hogar, id_pers, trimestre, round(prob_resp, 6) AS prob_resp, round(fep_aj, 6) AS fep_aj FROM puntaje""",
    PANEL_FINAL))
def attach_column(spark, sf):
    scored = panel_plan.scored_panel(base(spark, sf), 0.75)
    return rounded(scored.select(*PERSON, "trimestre", "prob_resp", "fep_aj"), prob_resp=6, fep_aj=6)


@query("b25_vector_to_rows", sql("SELECT estrato, t_per AS total_pob FROM metas", TARGETS))
def vector_to_rows(spark, sf):
    return quarterly_plan.household_targets(controls(spark, sf), "N_personas").withColumnRenamed("total", "total_pob")


@query("b26_data_of_design", sql("""
SELECT trimestre, mes_trimestre, upm, id_hogar, round(dk_anual_calib, 6) AS dk_anual_calib FROM hogcal2""", ANNUAL_CAL))
def data_of_design(spark, sf):
    design = annual_plan.calibrated_household_design(base(spark, sf), controls(spark, sf))
    return rounded(design.df.select(*quarterly_plan.HOME, "dk_anual_calib"), dk_anual_calib=6)


@query("b27_ungrouped", sql("SELECT round(sum(dk_anual), 2) AS tot_pers_dk FROM ajus2", ANNUAL))
def ungrouped(spark, sf):
    return annual(spark, sf).agg(F.round(F.sum("dk_anual"), 2).alias("tot_pers_dk"))


@query("g1_concatenate", sql("""
SELECT DISTINCT 'hh_' || dam || '_' || area AS estrato_hh, trimestre || '_' || mes_trimestre AS trim_mes FROM base"""))
def concatenate(spark, sf):
    return base(spark, sf).select(
        F.concat(F.lit("hh_"), joined("dam", "area")).alias("estrato_hh"), joined("trimestre", "mes_trimestre").alias("trim_mes")
    ).distinct()


@query("g2_round_half_even", sql("""
SELECT estrato, round_even(sum(fep) / 2, 0) AS mitad, round_even(avg(ingreso) / 1000, 1) AS miles
FROM base GROUP BY 1"""))
def round_half_even(spark, sf):
    return base(spark, sf).groupBy("estrato").agg(
        F.bround(F.sum("fep") / 2, 0).alias("mitad"), F.bround(F.avg("ingreso") / 1000, 1).alias("miles")
    )


@query("g3_square_root_and_absolute", sql("""
SELECT estrato, round(sqrt(sum(fep * fep)), 6) AS raiz, abs(sum(fep) - 100000) AS dif FROM base GROUP BY 1"""))
def root_and_absolute(spark, sf):
    return base(spark, sf).groupBy("estrato").agg(
        F.round(F.sqrt(F.sum(F.col("fep") * F.col("fep"))), 6).alias("raiz"),
        F.abs(F.sum("fep") - 100000).alias("dif"),
    )


@query("g4_pattern_replace", sql("""
SELECT regexp_replace('interaction(trim_mes, y)' || trim_mes || '.' || y, 'interaction\\(trim_mes, y\\)', '') AS nombre,
       count(*) AS n FROM cali2 WHERE regexp_matches(trim_mes || '.' || y, '\\.1$') GROUP BY 1""", ANNUAL_CAL))
def pattern_replace(spark, sf):
    people = annual_plan.annual_design(base(spark, sf), controls(spark, sf)).df
    raw = F.concat(F.lit("interaction(trim_mes, y)"), F.concat_ws(".", "trim_mes", "y"))
    return (
        people.select(F.regexp_replace(raw, r"interaction\(trim_mes, y\)", "").alias("nombre"))
        .where(F.col("nombre").rlike(r"\.1$"))
        .groupBy("nombre")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("g5_is_missing", sql("""
SELECT trimestre, count(*) FILTER (trabajo IS NULL) AS sin_trabajo, count(*) FILTER (pobreza IS NULL) AS sin_pobreza
FROM base GROUP BY 1"""))
def is_missing(spark, sf):
    return base(spark, sf).groupBy("trimestre").agg(
        F.count_if(F.col("trabajo").isNull()).alias("sin_trabajo"), F.count_if(F.col("pobreza").isNull()).alias("sin_pobreza")
    )


@query("g6_conditional", sql("""
SELECT id_hogar, trimestre, fep_long FROM hogpanel""", PANEL))
def conditional(spark, sf):
    panel = household_panel(base(spark, sf), "T1", "T2")
    long = F.when(F.col("respboth") == 1, F.col("fep_t1") / 0.75).otherwise(0.0)
    return panel.select("id_hogar", "trimestre", long.alias("fep_long"))


@query("g7_cast", sql("""
SELECT CAST(pobreza AS VARCHAR) AS pobreza, count(*) AS n FROM base WHERE CAST(id_pers AS VARCHAR) = '1' GROUP BY 1"""))
def cast_columns(spark, sf):
    firsts = base(spark, sf).where(F.col("id_pers").cast("string") == "1")
    return firsts.groupBy(F.col("pobreza").cast("string").alias("pobreza")).agg(F.count(F.lit(1)).alias("n"))


@query("g8_list_functions", sql("""
SELECT id_hogar, string_agg(trimestre, ',' ORDER BY trimestre) AS trimestres, CAST(count(*) AS INTEGER) AS n,
       CAST(count(*) * (count(*) - 1) / 2 AS INTEGER) AS pares
FROM (SELECT DISTINCT id_hogar, trimestre FROM base) GROUP BY 1"""))
def list_functions(spark, sf):
    from rotapanel.operators.overlap import periods_of

    lists = periods_of(base(spark, sf), ["id_hogar"])
    size = F.size("periodos")
    return lists.select(
        "id_hogar", F.array_join("periodos", ",").alias("trimestres"), size.alias("n"), (size * (size - 1) / 2).cast("int").alias("pares")
    )


@query("g9_crossed_factor", sql("""
SELECT trim_mes || '.' || y AS celda, count(*) AS n FROM cali2 GROUP BY 1""", ANNUAL_CAL))
def crossed_factor(spark, sf):
    people = annual_plan.annual_design(base(spark, sf), controls(spark, sf)).df
    return people.groupBy(F.concat_ws(".", "trim_mes", "y").alias("celda")).agg(F.count(F.lit(1)).alias("n"))


@query("g10_seeded_draw", sql("""
SELECT id_hogar, id_pers, trimestre,
       ('0x' || substr(md5(id_hogar || ':' || id_pers || ':' || trimestre || ':15'), 1, 8))::BIGINT % 1000 AS u
FROM base"""))
def seeded_draw(spark, sf):
    return base(spark, sf).select(*PERSON, "trimestre", hash_draw([*PERSON, "trimestre"], 15).alias("u"))


@query("g11_smaller_of_two", sql("""
SELECT id_hogar, least(max(fep) FILTER (trimestre = 'T1'), max(fep) FILTER (trimestre = 'T2')) AS comun
FROM hogares GROUP BY 1 HAVING count(*) = 2""", PANEL))
def smaller_of_two(spark, sf):
    wide = to_wide(households(base(spark, sf, ["T1", "T2"])), ["id_hogar"], "trimestre", F.max("fep"), ["T1", "T2"])
    both = wide.where(F.col("T1").isNotNull() & F.col("T2").isNotNull())
    return both.select("id_hogar", F.least("T1", "T2").alias("comun"))


@query("g12_inverse_logit", sql("""
SELECT id_hogar, id_pers, trimestre,
       round(exp(0.5 - edad / 100.0::DOUBLE) / (1 + exp(0.5 - edad / 100.0::DOUBLE)), 9) AS phi FROM base"""))
def logistic(spark, sf):
    eta = F.lit(0.5) - F.col("edad") / 100.0
    return base(spark, sf).select(*PERSON, "trimestre", F.round(inverse_logit(eta), 9).alias("phi"))
