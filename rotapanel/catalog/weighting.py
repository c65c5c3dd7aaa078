"""Survey designs and accumulated weights."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import ANNUAL, QUARTERLY, QUARTERLY_CAL, annual, base, controls, quarterly, rounded, sql, variance
from rotapanel.catalog.registry import query
from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.estimation import survey_total
from rotapanel.operators.longitudinal import PERSON
from rotapanel.operators.weights import coherence, mean_weight, pool_rounds, size_normalised_weights
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.microdata import QUARTERS


@query("h1_design_units", sql("""
SELECT estrato, count(DISTINCT upm) AS n_psu FROM base GROUP BY 1"""))
def design_units(spark, sf):
    return SurveyDesign(base(spark, sf), "fep").strata_sizes()


@query("h2_units_in_several_strata", sql("""
SELECT count(*) AS repetidas FROM (SELECT upm FROM base GROUP BY 1 HAVING count(DISTINCT estrato) > 1)"""))
def units_in_several_strata(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep", nest=False).check_units()
    return design.units_in_several_strata().agg(F.count(F.lit(1)).alias("repetidas"))


@query("h3_design_as_table", sql("SELECT id_hogar, id_pers, trimestre, estrato, upm, fep FROM base"))
def design_as_table(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep")
    return design.df.select(*PERSON, "trimestre", design.strata, design.psu, design.weight)


@query("h4_domain_of_design", sql(
    """
SELECT trimestre, round(t, 2) AS total, round(sqrt(v), 4) AS se
FROM (SELECT trimestre, sum(fep) AS t FROM base WHERE sexo = 'Hombre' AND estrato < '2' GROUP BY 1) JOIN vd USING (trimestre)""",
    variance("base", ["trimestre"], "fep", "sexo = 'Hombre' AND estrato < '2'", "vd"),
))
def domain_of_design(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep").where((F.col("sexo") == "Hombre") & (F.col("estrato") < "2"))
    return rounded(survey_total(design, ["trimestre"]).select("trimestre", "total", "se"), total=2, se=4)


@query("h4_subset_before_design", sql(
    """
SELECT trimestre, round(t, 2) AS total, round(sqrt(v), 4) AS se
FROM (SELECT trimestre, sum(fep) AS t FROM sub GROUP BY 1) JOIN vd USING (trimestre)""",
    ", sub AS (SELECT * FROM base WHERE sexo = 'Hombre' AND mes_trimestre = 'M3')",
    variance("sub", ["trimestre"], "fep", name="vd"),
))
def subset_before_design(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep").subset((F.col("sexo") == "Hombre") & (F.col("mes_trimestre") == "M3"))
    return rounded(survey_total(design, ["trimestre"]).select("trimestre", "total", "se"), total=2, se=4)


@query("h5_pooled_rounds", sql("""
SELECT trabajo, sum(fep / 4) AS w, count(*) AS n FROM base GROUP BY 1"""))
def pooled(spark, sf):
    people = base(spark, sf)
    rounds = [people.where(F.col("trimestre") == q) for q in QUARTERS]
    return pool_rounds(rounds).groupBy("trabajo").agg(F.sum("w_pool").alias("w"), F.count(F.lit(1)).alias("n"))


@query("h6_quarterly_weights", sql("SELECT id_hogar, id_pers, trimestre, ai, dk_mes FROM ajus", QUARTERLY))
def quarterly_accumulated(spark, sf):
    return quarterly(spark, sf).select(*PERSON, "trimestre", "ai", "dk_mes")


@query("h7_annual_weights", sql("SELECT id_hogar, id_pers, trimestre, bi, dk_anual FROM ajus2", ANNUAL))
def annual_accumulated(spark, sf):
    return annual(spark, sf).select(*PERSON, "trimestre", "bi", "dk_anual")


def _normalised_sql(within: str) -> str:
    return f"""
, partes AS (
  SELECT estrato, trimestre, mes_trimestre, count(*) / sum(count(*)) OVER (PARTITION BY estrato{within}) AS delta
  FROM base GROUP BY 1, 2, 3)
SELECT id_hogar, id_pers, b.trimestre, delta, fep * delta AS dk_norm
FROM base b JOIN partes p ON b.estrato = p.estrato AND b.trimestre = p.trimestre AND b.mes_trimestre = p.mes_trimestre"""


@query("h8_size_normalised_quarter", sql(_normalised_sql(", trimestre")))
def size_normalised_quarter(spark, sf):
    return size_normalised_weights(base(spark, sf)).select(*PERSON, "trimestre", "delta", "dk_norm")


@query("h9_size_normalised_year", sql(_normalised_sql("")))
def size_normalised_year(spark, sf):
    return size_normalised_weights(base(spark, sf), within=[]).select(*PERSON, "trimestre", "delta", "dk_norm")


@query("h10_coherence_by_domain", sql("""
SELECT dam, area, round(sum(dk_anual), 2) AS n_hat, any_value(N_personas) AS control,
       round((sum(dk_anual) - any_value(N_personas)) / any_value(N_personas), 6) AS rel_diff
FROM ajus2 JOIN poblacion USING (dam, area) GROUP BY 1, 2""", ANNUAL))
def coherence_by_domain(spark, sf):
    out = coherence(annual(spark, sf), "dk_anual", controls(spark, sf), "N_personas", ["dam", "area"])
    return rounded(out, n_hat=2, rel_diff=6)


@query("h10_coherence_national", sql("""
SELECT round(n_hat, 2) AS n_hat, control, round((n_hat - control) / control, 6) AS rel_diff
FROM (SELECT sum(dk_anual) AS n_hat FROM ajus2), (SELECT sum(N_personas) AS control FROM poblacion)""", ANNUAL))
def coherence_national(spark, sf):
    out = coherence(annual(spark, sf), "dk_anual", controls(spark, sf), "N_personas", [])
    return rounded(out, n_hat=2, rel_diff=6)


@query("h11_quarterly_totals", sql("""
SELECT trimestre, round(sum(dk_mes) FILTER (id_pers = 1), 2) AS hogares, round(sum(dk_mes), 2) AS personas
FROM ajus GROUP BY 1""", QUARTERLY))
def quarterly_totals(spark, sf):
    home = F.when(F.col("id_pers") == 1, F.col("dk_mes"))
    return quarterly(spark, sf).groupBy("trimestre").agg(
        F.round(F.sum(home), 2).alias("hogares"), F.round(F.sum("dk_mes"), 2).alias("personas")
    )


@query("h11_monthly_totals", sql("""
SELECT trimestre, mes_trimestre, sum(fep) FILTER (id_pers = 1) AS hogares, sum(fep) AS personas FROM base GROUP BY 1, 2"""))
def monthly_totals(spark, sf):
    home = F.when(F.col("id_pers") == 1, F.col("fep"))
    return base(spark, sf).groupBy("trimestre", "mes_trimestre").agg(
        F.sum(home).alias("hogares"), F.sum("fep").alias("personas")
    )


@query("h12_annual_totals", sql("""
SELECT round(sum(dk_anual) FILTER (id_pers = 1), 2) AS hogares, round(sum(dk_anual), 2) AS personas FROM ajus2""", ANNUAL))
def annual_totals(spark, sf):
    home = F.when(F.col("id_pers") == 1, F.col("dk_anual"))
    return annual(spark, sf).agg(
        F.round(F.sum(home), 2).alias("hogares"), F.round(F.sum("dk_anual"), 2).alias("personas")
    )


@query("h13_weight_stability", sql("""
, medias AS (SELECT trimestre, mes_trimestre, sexo, sum(dk_mes_cali) / count(*) AS prop FROM cali GROUP BY 1, 2, 3)
SELECT trimestre, sexo, round(min(prop), 6) AS menor, round(max(prop), 6) AS mayor, round(max(prop) / min(prop), 6) AS razon
FROM medias GROUP BY 1, 2""", QUARTERLY_CAL))
def weight_stability(spark, sf):
    people = quarterly_plan.calibrated_persons(base(spark, sf), controls(spark, sf))
    means = mean_weight(people, "dk_mes_cali", ["sexo"])
    low, high = F.min("prop"), F.max("prop")
    return means.groupBy("trimestre", "sexo").agg(
        F.round(low, 6).alias("menor"), F.round(high, 6).alias("mayor"), F.round(high / low, 6).alias("razon")
    )
