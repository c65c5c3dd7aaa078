"""Panel overlap and longitudinal weights."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import (
    PANEL, PANEL_FINAL, PANEL_PROBABILITY, TARGETS, base, controls, rounded, scratch, sql,
)
from rotapanel.catalog.registry import query
from rotapanel.operators.longitudinal import (
    PERSON, adjusted_weight, basic_weight, household_panel, mean_response_rate, person_panel, persons_of_panel,
    weight_of_newcomers, with_household_weight, with_person_flag, without_exits, zero_for_nonresponse, longitudinal_base,
)
from rotapanel.operators.overlap import (
    attrition_pattern, counts_by_month, overlap_share, presence, rotation_slots, scheme_overlap, seen_in_all, shared_units,
    state_spells, trajectories, units_per_quarter,
)
from rotapanel.operators.propensity import auc, balance, coefficients, common_support, fit_response, predict_response, roc_points
from rotapanel.plans import panel as panel_plan
from rotapanel.session import join_small, stored

SIMPLE = ["sexo", "ingreso"]
RICH = ["pobreza", "area", "etnia", "sexo", "edad"]


def _people(spark, sf):
    return person_panel(base(spark, sf), "T1", "T2", PANEL_PROBABILITY)


def _scored(spark, sf, covariates):
    return panel_plan.scored_panel(base(spark, sf), PANEL_PROBABILITY, covariates)


def _months_sql(unit: str) -> str:
    parts = ", ".join(f"count({unit}) FILTER (mes_trimestre = 'M{i}') AS M{i}" for i in (1, 2, 3))
    total = " + ".join(f"count({unit}) FILTER (mes_trimestre = 'M{i}')" for i in (1, 2, 3))
    return f"SELECT trimestre, {parts}, {total} AS Total FROM base GROUP BY 1"


@query("k1_units_by_month", sql(_months_sql("DISTINCT upm")))
def units_by_month(spark, sf):
    return counts_by_month(base(spark, sf), ["upm"], "n_upm")


@query("k1_households_by_month", sql(_months_sql("DISTINCT (upm, id_hogar)")))
def households_by_month(spark, sf):
    return counts_by_month(base(spark, sf), ["upm", "id_hogar"], "n_hogar")


@query("k1_persons_by_month", sql(_months_sql("*")))
def persons_by_month(spark, sf):
    return counts_by_month(base(spark, sf), None, "n_pers")


@query("k2_units_per_quarter", sql("""
SELECT trimestre, count(DISTINCT id_hogar) AS hogares, count(DISTINCT upm) AS upm FROM base GROUP BY 1"""))
def per_quarter(spark, sf):
    return units_per_quarter(base(spark, sf))


@query("k3_overlap_of_units", sql("""
SELECT a.trimestre AS trimestre_1, b.trimestre AS trimestre_2, count(*) AS traslape
FROM (SELECT DISTINCT upm, trimestre FROM base) a JOIN (SELECT DISTINCT upm, trimestre FROM base) b
  ON a.upm = b.upm AND a.trimestre < b.trimestre GROUP BY 1, 2"""))
def overlap_of_units(spark, sf):
    return shared_units(base(spark, sf), ["upm"])


@query("k4_observed_overlap_share", sql("""
, h AS (SELECT DISTINCT id_hogar, trimestre FROM base)
SELECT a.trimestre AS trimestre_1, b.trimestre AS trimestre_2, count(*) AS traslape,
       (SELECT count(*) FROM h WHERE trimestre = a.trimestre) AS n_1,
       count(*) / (SELECT count(*) FROM h WHERE trimestre = a.trimestre) AS t
FROM h a JOIN h b ON a.id_hogar = b.id_hogar AND a.trimestre < b.trimestre GROUP BY 1, 2"""))
def observed_overlap(spark, sf):
    return overlap_share(base(spark, sf), ["id_hogar"])


@query("k4_expected_and_observed_overlap", sql("""
, h AS (SELECT DISTINCT id_hogar, CAST(substr(trimestre, 2, 1) AS INTEGER) AS p FROM base)
SELECT a.p AS period_1, b.p AS period_2, greatest(0, 4 - (b.p - a.p)) / 4 AS share,
       round(count(*) / (SELECT count(*) FROM h WHERE p = a.p), 9) AS t
FROM h a JOIN h b ON a.id_hogar = b.id_hogar AND a.p < b.p GROUP BY 1, 2"""))
def expected_and_observed(spark, sf):
    def number(c):
        return F.substring(c, 2, 1).cast("int")

    observed = overlap_share(base(spark, sf), ["id_hogar"]).select(
        number("trimestre_1").alias("period_1"), number("trimestre_2").alias("period_2"), F.round("t", 9).alias("t")
    )
    return scheme_overlap(rotation_slots(spark, stay=4, periods=4)).join(observed, ["period_1", "period_2"])


@query("k5_rotation_of_households", sql("""
, h AS (SELECT DISTINCT id_hogar, CAST(substr(trimestre, 2, 1) AS INTEGER) AS period FROM base)
SELECT h.period, CAST(s.slot AS INTEGER) AS slot, CAST(h.period + s.slot - 4 AS INTEGER) AS panel, count(*) AS hogares
FROM h JOIN (VALUES (1), (2), (3), (4)) s(slot) ON s.slot = h.id_hogar % 4 + 1 GROUP BY 1, 2, 3"""))
def rotation_of_households(spark, sf):
    homes = base(spark, sf).select("id_hogar", "trimestre").distinct().select(
        F.substring("trimestre", 2, 1).cast("int").alias("period"), (F.col("id_hogar") % 4 + 1).cast("int").alias("slot")
    )
    counts = homes.groupBy("period", "slot").agg(F.count(F.lit(1)).alias("hogares"))
    return counts.join(rotation_slots(spark, stay=4, periods=4), ["period", "slot"])


@query("k6_households_in_both", sql("SELECT id_hogar FROM ambos", PANEL))
def households_in_both(spark, sf):
    return seen_in_all(base(spark, sf), ["id_hogar"], ["T1", "T2"])


@query("k7_households_in_k_quarters", sql("""
, h AS (SELECT id_hogar, count(DISTINCT trimestre) FILTER (trimestre IN ('T1', 'T2')) AS a,
               count(DISTINCT trimestre) FILTER (trimestre IN ('T1', 'T2', 'T3')) AS b, count(DISTINCT trimestre) AS c
        FROM base GROUP BY 1)
SELECT 2 AS k, count(*) FILTER (a = 2) AS hogares FROM h UNION ALL SELECT 3, count(*) FILTER (b = 3) FROM h
UNION ALL SELECT 4, count(*) FILTER (c = 4) FROM h"""))
def households_in_k(spark, sf):
    out = None
    for k in (2, 3, 4):
        ids = seen_in_all(base(spark, sf), ["id_hogar"], ["T1", "T2", "T3", "T4"][:k])
        row = ids.agg(F.count(F.lit(1)).alias("hogares")).select(F.lit(k).alias("k"), "hogares")
        out = row if out is None else out.unionByName(row)
    return out


@query("k8_response_flag", sql("""
SELECT id_hogar, trimestre, upm, fep, fep_t1, respboth FROM hogpanel""", PANEL))
def response_flag(spark, sf):
    return household_panel(base(spark, sf), "T1", "T2").select("id_hogar", "trimestre", "upm", "fep", "fep_t1", "respboth")


@query("k9_basic_longitudinal_weight", sql("SELECT id_hogar, trimestre, fep_t1, fep_long FROM hogpanel", PANEL))
def basic_longitudinal(spark, sf):
    panel = household_panel(base(spark, sf), "T1", "T2")
    return panel.select("id_hogar", "trimestre", "fep_t1", basic_weight(PANEL_PROBABILITY).alias("fep_long"))


@query("k10_panel_probability", sql("""
SELECT id_hogar, trimestre, respboth, CASE WHEN respboth = 1 THEN fep_t1 / 0.75::DOUBLE ELSE 0 END AS fep_long FROM hogpanel""", PANEL))
def panel_probability(spark, sf):
    shares = scheme_overlap(rotation_slots(spark, stay=4, periods=2)).where("period_1 = 1 and period_2 = 2")
    probability = shares.first().share  # one row: shared panels of the schedule
    panel = household_panel(base(spark, sf), "T1", "T2")
    return panel.select("id_hogar", "trimestre", "respboth", basic_weight(probability).alias("fep_long"))


@query("k11_basic_weight_check", sql("""
SELECT trimestre, (SELECT sum(fep_long) FROM hogpanel WHERE trimestre = h.trimestre) AS hogares_long, sum(fep) AS hogares,
       (SELECT sum(fep_long) FROM hogpanel p JOIN base b ON p.id_hogar = b.id_hogar AND p.trimestre = b.trimestre
        WHERE p.trimestre = h.trimestre) AS personas_long,
       (SELECT sum(fep) FROM base b WHERE b.trimestre = h.trimestre) AS personas
FROM hogares h GROUP BY trimestre""", PANEL.replace("0.75", "0.5")))
def basic_weight_check(spark, sf):
    people = base(spark, sf, ["T1", "T2"])
    homes = people.groupBy("id_hogar", "trimestre").agg(F.count(F.lit(1)).alias("n"), F.max("fep").alias("fep"))
    panel = household_panel(people, "T1", "T2").select("id_hogar", "trimestre", basic_weight(0.5).alias("fep_long"))
    n = F.col("n")
    return homes.join(panel, ["id_hogar", "trimestre"], "left").groupBy("trimestre").agg(
        F.sum("fep_long").alias("hogares_long"),
        F.sum("fep").alias("hogares"),
        F.sum(F.col("fep_long") * n).alias("personas_long"),
        F.sum(F.col("fep") * n).alias("personas"),
    )


@query("k12_persons_in_both", sql("SELECT id_hogar, id_pers, trimestre, respboth_per FROM gente", PANEL))
def persons_in_both(spark, sf):
    people = with_person_flag(persons_of_panel(base(spark, sf), "T1", "T2"), "T1", "T2")
    return people.select(*PERSON, "trimestre", "respboth_per")


@query("k13_household_weight_on_persons", sql("SELECT id_hogar, id_pers, trimestre, fep_long FROM gente", PANEL))
def household_weight_on_persons(spark, sf):
    panel = household_panel(base(spark, sf), "T1", "T2").withColumn("fep_long", basic_weight(PANEL_PROBABILITY))
    people = with_household_weight(persons_of_panel(base(spark, sf), "T1", "T2"), panel)
    return people.select(*PERSON, "trimestre", "fep_long")


# Newton's method for the logit on sex and income (per 100,000), written out in SQL.
LOGIT = """, x AS (
  SELECT id_hogar, id_pers, trimestre, estrato, fep_long, respboth_per, CASE WHEN sexo = 'Mujer' THEN 1.0::DOUBLE ELSE 0 END AS u,
         ingreso / 100000.0::DOUBLE AS v, CAST(respboth_per AS DOUBLE) AS y FROM gente),
nr AS (
  WITH RECURSIVE pasos(it, b0, b1, b2, e0, e1, e2) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT it + 1,
           b0 + (g0 * (c * f - e * e) + g1 * (d * e - b * f) + g2 * (b * e - c * d)) / det,
           b1 + (g0 * (d * e - b * f) + g1 * (a * f - d * d) + g2 * (b * d - a * e)) / det,
           b2 + (g0 * (b * e - c * d) + g1 * (b * d - a * e) + g2 * (a * c - b * b)) / det,
           sqrt((c * f - e * e) / det), sqrt((a * f - d * d) / det), sqrt((a * c - b * b) / det)
    FROM (
      SELECT *, a * (c * f - e * e) - b * (b * f - d * e) + d * (b * e - c * d) AS det FROM (
        SELECT it, b0, b1, b2, sum(y - p) AS g0, sum(u * (y - p)) AS g1, sum(v * (y - p)) AS g2, sum(w) AS a, sum(w * u) AS b,
               sum(w * u * u) AS c, sum(w * v) AS d, sum(w * u * v) AS e, sum(w * v * v) AS f
        FROM (SELECT *, p * (1 - p) AS w FROM (
          SELECT it, b0, b1, b2, u, v, y, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM pasos, x WHERE it < 12))
        GROUP BY it, b0, b1, b2)))
  SELECT * FROM pasos WHERE it = 12),
nota AS (SELECT x.*, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS prob_resp FROM x, nr)
"""


def _per_100k(people):
    return people.withColumn("ingreso", F.col("ingreso") / 100000)


@query("k14_propensity_logit", sql(
    """
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate FROM nr UNION ALL SELECT 'sexo_Mujer', round(b1, 6) FROM nr
UNION ALL SELECT 'ingreso', round(b2, 6) FROM nr""", PANEL, LOGIT))
def propensity_logit(spark, sf):
    people = stored(_per_100k(_people(spark, sf)))
    model = fit_response(people, "respboth_per", SIMPLE)
    return rounded(coefficients(model, people).select("term", "estimate"), estimate=6)


@query("k17_coefficients_with_error", sql(
    """
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate, round(e0, 6) AS se, round(b0 / e0, 4) AS t FROM nr
UNION ALL SELECT 'sexo_Mujer', round(b1, 6), round(e1, 6), round(b1 / e1, 4) FROM nr
UNION ALL SELECT 'ingreso', round(b2, 6), round(e2, 6), round(b2 / e2, 4) FROM nr""", PANEL, LOGIT))
def coefficients_with_error(spark, sf):
    people = stored(_per_100k(_people(spark, sf)))
    table = coefficients(fit_response(people, "respboth_per", SIMPLE), people)
    return rounded(table.drop("p"), estimate=6, se=6, t=4)


@query("k15_propensity_logit_categorical")
def propensity_logit_categorical(spark, sf):
    people = stored(_people(spark, sf).withColumn("pobreza", F.col("pobreza").cast("string")))
    model = fit_response(people, "respboth_per", RICH)
    return rounded(coefficients(model, people).select("term", "estimate"), estimate=6)


def _score_sql(source: str, y: str, factors: list[str], numbers: list[str]) -> str:
    """Sums of the response by every level and number: at the maximum the fitted ones are equal to them."""
    parts = [f"SELECT '{c}=' || {c} AS term, sum({y}) AS total FROM {source} GROUP BY 1" for c in factors]
    parts += [f"SELECT '{c}' AS term, sum({y} * {c}) AS total FROM {source}" for c in numbers]
    return "SELECT term, round(CAST(total AS DOUBLE), 2) AS total FROM (" + " UNION ALL ".join(parts) + ")"


def _score_sums(scored, factors: list[str], numbers: list[str]):
    """The same sums of the fitted probabilities, in one pass."""
    p = F.col("prob_resp")
    entries = [F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("term"), p.alias("v")) for c in factors]
    entries += [F.struct(F.lit(c).alias("term"), (p * F.col(c)).alias("v")) for c in numbers]
    rows = scored.where(p.isNotNull()).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return rows.groupBy("term").agg(F.round(F.sum("v"), 2).alias("total"))


@query("k15_logit_score_equations", sql(
    _score_sql("(SELECT * FROM gente WHERE pobreza IS NOT NULL)", "respboth_per", ["pobreza", "area", "etnia", "sexo"], ["edad"]), PANEL))
def logit_score_equations(spark, sf):
    people = stored(_people(spark, sf).withColumn("pobreza", F.col("pobreza").cast("string")))
    scored = predict_response(fit_response(people, "respboth_per", RICH), people, RICH)
    return _score_sums(scored, ["pobreza", "area", "etnia", "sexo"], ["edad"])


@query("k23_logit_score_equations", sql(
    _score_sql("(SELECT * FROM gente WHERE trimestre = 'T1')", "respboth_per", ["sexo", "area"], ["edad"]), PANEL))
def second_logit_score_equations(spark, sf):
    people = stored(_people(spark, sf).where(F.col("trimestre") == "T1"))
    covariates = ["sexo", "edad", "area"]
    scored = predict_response(fit_response(people, "respboth_per", covariates), people, covariates)
    return _score_sums(scored, ["sexo", "area"], ["edad"])


@query("k16_predicted_probabilities", sql(
    "SELECT id_hogar, id_pers, trimestre, respboth_per, round(prob_resp, 6) AS prob_resp FROM nota", PANEL, LOGIT))
def predicted(spark, sf):
    return rounded(_scored(spark, sf, SIMPLE).select(*PERSON, "trimestre", "respboth_per", "prob_resp"), prob_resp=6)


# Two-sided normal tail by the series exp(-x^2) sum x^(2k+1) / gamma(k + 3/2), x = |t| / sqrt(2).
_NORMAL_TAIL = "round(1 - (SELECT sum(exp((2 * k + 1) * ln(abs(t) / sqrt(2)) - t * t / 2 - lgamma(k + 1.5))) FROM range(300) q(k)), 6)"


@query("k17_coefficient_table", sql(
    f"""
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(t, 4) AS t, {_NORMAL_TAIL} AS p FROM (
  SELECT '(Intercept)' AS term, b0 AS estimate, e0 AS se, b0 / e0 AS t FROM nr UNION ALL SELECT 'sexo_Mujer', b1, e1, b1 / e1 FROM nr
  UNION ALL SELECT 'ingreso', b2 / 100000, e2 / 100000, b2 / e2 FROM nr)""", PANEL, LOGIT))
def coefficient_table(spark, sf):
    people = stored(_people(spark, sf))
    model = fit_response(people, "respboth_per", SIMPLE)
    return rounded(coefficients(model, people), estimate=6, se=6, t=4, p=6)


# A stated score lets SQL check the curve; the fitted score is checked in the tests.
SCORE_SQL = ", notas AS (SELECT respboth_per AS y, 1 / (1 + exp((edad - 50) / 20.0::DOUBLE + id_pers / 4.0::DOUBLE)) AS s FROM gente)"


def _stated_score(spark, sf):
    score = 1 / (1 + F.exp((F.col("edad") - 50) / 20.0 + F.col("id_pers") / 4.0))
    return _people(spark, sf).withColumn("s", F.round(score, 12))


@query("k18_roc_points", sql(
    """
, r AS (SELECT round(s, 12) AS score, y FROM notas),
g AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM r GROUP BY 1),
a AS (SELECT *, sum(pos) OVER () AS p, sum(neg) OVER () AS q, sum(pos) OVER (ORDER BY score) AS cp, sum(neg) OVER (ORDER BY score) AS cn FROM g)
SELECT score, round((p - cp + pos) / p, 9) AS sensitivity, round((cn - neg) / q, 9) AS specificity FROM a""",
    PANEL, SCORE_SQL,
))
def roc(spark, sf):
    points = roc_points(_stated_score(spark, sf), "respboth_per", "s")
    return rounded(points.select("score", "sensitivity", "specificity"), sensitivity=9, specificity=9)


@query("k18_area_under_curve", sql(
    """
, r AS (SELECT y, rank() OVER (ORDER BY round(s, 12)) AS lo, count(*) OVER (PARTITION BY round(s, 12)) AS k FROM notas)
SELECT round((sum(lo + (k - 1) / 2.0) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r""",
    PANEL, SCORE_SQL,
))
def area_under_curve(spark, sf):
    return rounded(auc(_stated_score(spark, sf), "respboth_per", "s"), auc=9)


@query("k18_area_under_curve_fitted", sql(
    """
, r AS (SELECT y, rank() OVER (ORDER BY round(prob_resp, 9)) AS lo, count(*) OVER (PARTITION BY round(prob_resp, 9)) AS k FROM nota)
SELECT round((sum(lo + (k - 1) / 2.0) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 5) AS auc FROM r""",
    PANEL, LOGIT))
def area_under_fitted_curve(spark, sf):
    scored = _scored(spark, sf, SIMPLE).withColumn("prob_resp", F.round("prob_resp", 9))
    return rounded(auc(scored, "respboth_per", "prob_resp"), auc=5)


@query("k19_adjusted_weight", sql(
    "SELECT id_hogar, id_pers, trimestre, fep_long, round(fep_long / prob_resp, 4) AS fep_aj FROM nota", PANEL, LOGIT))
def adjusted(spark, sf):
    scored = _scored(spark, sf, SIMPLE).withColumn("fep_aj", adjusted_weight())
    return rounded(scored.select(*PERSON, "trimestre", "fep_long", "fep_aj"), fep_aj=4)


@query("k20_mean_response_rate", sql("""
SELECT estrato, count(*) AS n, round(avg(CAST(respboth_per AS DOUBLE)), 9) AS prob_resp FROM gente GROUP BY 1""", PANEL))
def mean_rate(spark, sf):
    return rounded(mean_response_rate(_people(spark, sf), ["estrato"]), prob_resp=9)


@query("k20_adjusted_by_mean_rate", sql("""
SELECT id_hogar, id_pers, trimestre, round(fep_aj, 6) AS fep_aj FROM puntaje""", PANEL_FINAL))
def adjusted_by_mean_rate(spark, sf):
    return rounded(_scored(spark, sf, None).select(*PERSON, "trimestre", "fep_aj"), fep_aj=6)


@query("k21_weight_of_newcomers", sql("""
, w AS (SELECT g.*, CASE WHEN trimestre = 'T2' AND respboth_per = 0 THEN NULL ELSE fep_long END AS peso FROM gente g)
SELECT id_hogar, id_pers, trimestre, coalesce(peso, max(peso) OVER (PARTITION BY id_hogar)) AS peso FROM w""", PANEL))
def newcomers(spark, sf):
    new = (F.col("trimestre") == "T2") & (F.col("respboth_per") == 0)
    people = _people(spark, sf).withColumn("peso", F.when(~new, F.col("fep_long")))
    return weight_of_newcomers(people, "peso").select(*PERSON, "trimestre", "peso")


@query("k22_zero_for_nonresponse", sql("""
SELECT id_hogar, id_pers, trimestre, CASE WHEN respboth_per = 1 THEN fep_long ELSE 0 END AS peso FROM gente""", PANEL))
def zero_weight(spark, sf):
    return _people(spark, sf).select(*PERSON, "trimestre", zero_for_nonresponse("fep_long", "respboth_per").alias("peso"))


@query("k23_second_period_weight", sql("""
, uno AS (SELECT * FROM gente WHERE trimestre = 'T1'),
con AS (SELECT u.*, CASE WHEN b.pobreza IS NULL THEN 0 ELSE 1 END AS resp_2 FROM uno u
        LEFT JOIN base b ON b.id_hogar = u.id_hogar AND b.id_pers = u.id_pers AND b.trimestre = 'T2'),
tasa2 AS (SELECT area, sexo, avg(CAST(resp_2 AS DOUBLE)) AS phi FROM con GROUP BY 1, 2)
SELECT id_hogar, id_pers, resp_2, round(CASE WHEN resp_2 = 1 THEN fep_long / phi ELSE 0 END, 6) AS peso_2
FROM con JOIN tasa2 USING (area, sexo)""", PANEL))
def second_period(spark, sf):
    people = _people(spark, sf)
    answered = F.max(F.when((F.col("trimestre") == "T2") & F.col("pobreza").isNotNull(), 1).otherwise(0)).alias("resp_2")
    q1 = F.col("trimestre") == "T1"
    # One row per person of the first quarter, with the answer in the second.
    rows = people.groupBy(*PERSON).agg(
        answered, *[F.max(F.when(q1, F.col(c))).alias(c) for c in ("area", "sexo", "fep_long")]
    ).where(F.col("fep_long").isNotNull())
    rates = mean_response_rate(rows, ["area", "sexo"], "resp_2").drop("n")
    weighted = join_small(rows, rates, ["area", "sexo"])
    out = weighted.withColumn("d", adjusted_weight()).select(
        *PERSON, "resp_2", zero_for_nonresponse("d", "resp_2").alias("peso_2")
    )
    return rounded(out, peso_2=6)


@query("k23_second_period_logit")
def second_period_logit(spark, sf):
    people = stored(_people(spark, sf).where(F.col("trimestre") == "T1"))
    model = fit_response(people, "respboth_per", ["sexo", "edad", "area"])
    scored = predict_response(model, people, ["sexo", "edad", "area"]).withColumn("d", adjusted_weight())
    return rounded(scored.select(*PERSON, zero_for_nonresponse("d", "respboth_per").alias("peso_2")), peso_2=4)


def _moments_sql(name: str, x: str) -> str:
    return f"SELECT '{name}' AS covariate, respboth_per AS r, avg({x}) AS m, var_samp({x}) AS v FROM gente GROUP BY 2"


@query("k24_covariate_balance", sql(
    f"""
, mom AS ({_moments_sql('edad', 'CAST(edad AS DOUBLE)')} UNION ALL {_moments_sql('ingreso', 'ingreso')}
  UNION ALL {_moments_sql('mujer', "CASE WHEN sexo = 'Mujer' THEN 1.0::DOUBLE ELSE 0 END")})
SELECT covariate, round(max(m) FILTER (r = 1), 6) AS mean_1, round(max(m) FILTER (r = 0), 6) AS mean_0,
       round((max(m) FILTER (r = 1) - max(m) FILTER (r = 0)) / sqrt(sum(v) / 2), 8) AS smd FROM mom GROUP BY 1""", PANEL
))
def covariate_balance(spark, sf):
    covariates = {
        "edad": F.col("edad"), "ingreso": F.col("ingreso"), "mujer": F.when(F.col("sexo") == "Mujer", 1).otherwise(0),
    }
    return rounded(balance(_people(spark, sf), "respboth_per", covariates), mean_1=6, mean_0=6, smd=8)


@query("k24_common_support", sql(
    """
SELECT CAST(least(floor(round(s, 12) * 10) + 1, 10) AS BIGINT) AS bin, count(*) FILTER (y = 1) AS n_1, count(*) FILTER (y = 0) AS n_0,
       round(min(s), 9) AS lowest, round(max(s), 9) AS highest FROM notas GROUP BY 1""", PANEL, SCORE_SQL))
def support(spark, sf):
    return rounded(common_support(_stated_score(spark, sf), "respboth_per", "s"), lowest=9, highest=9)


@query("k25_attrition_pattern", sql("""
, f AS (SELECT c_custkey, bool_or(b.trimestre = 'T1') AS a, bool_or(b.trimestre = 'T2') AS b FROM customer
        LEFT JOIN base b ON b.id_hogar = c_custkey GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'ambos' WHEN a THEN 'solo_t1' WHEN b THEN 'solo_t2' ELSE 'ninguno' END AS patron, count(*) AS n
FROM f GROUP BY 1"""))
def attrition(spark, sf):
    frame = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id_hogar"))
    seen = presence(base(spark, sf, ["T1", "T2"]), ["id_hogar"], "T1", "T2")
    return attrition_pattern(frame.join(seen, "id_hogar", "left"), ["id_hogar"])


@query("k26_longitudinal_sample", sql("""
SELECT trimestre, respboth_per, count(*) AS n, sum(fep) AS w FROM gente GROUP BY 1, 2 HAVING respboth_per = 1""", PANEL))
def longitudinal_sample(spark, sf):
    both = _people(spark, sf).where(F.col("respboth_per") == 1)
    return both.groupBy("trimestre", "respboth_per").agg(F.count(F.lit(1)).alias("n"), F.sum("fep").alias("w"))


@query("k27_longitudinal_base", sql("""
SELECT id_hogar, id_pers, upm, estrato, edad, sexo, area, round(fep_aj, 6) AS fep_aj, pobreza_t1, pobreza_t2 FROM panel""",
    PANEL_FINAL))
def final_rows(spark, sf):
    both = _scored(spark, sf, None).where(F.col("respboth_per") == 1)
    return rounded(longitudinal_base(both, "pobreza", "T1", "T2", panel_plan.ATTRIBUTES), fep_aj=6)


@query("k28_without_exits", sql("""
, salidas AS (SELECT id_hogar, id_pers FROM base WHERE trimestre = 'T2' AND edad >= 80)
SELECT id_hogar, id_pers, trimestre FROM gente g
WHERE NOT EXISTS (SELECT 1 FROM salidas s WHERE s.id_hogar = g.id_hogar AND s.id_pers = g.id_pers)""", PANEL))
def exits_left_out(spark, sf):
    exits = base(spark, sf, ["T2"]).where(F.col("edad") >= 80)
    return without_exits(_people(spark, sf), exits).select(*PERSON, "trimestre")


@query("k29_weight_chain", sql(
    """
SELECT m.estrato, count(*) AS n, round(sum(fep_long / prob_resp), 2) AS fep_aj, round(any_value(t_per), 2) AS fex_cali
FROM nota JOIN metas m ON nota.estrato = m.estrato WHERE trimestre = 'T1' AND respboth_per = 1 GROUP BY 1""", PANEL, TARGETS, LOGIT))
def weight_chain(spark, sf):
    scored = _scored(spark, sf, SIMPLE)
    final = panel_plan.final_base(scored, controls(spark, sf), "pobreza")
    kept = panel_plan.store_final(final, scratch(spark, sf, "cadena"))
    sums = kept.groupBy("estrato").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fep_aj").alias("fep_aj"), F.sum("fex_cali").alias("fex_cali")
    )
    return rounded(sums, fep_aj=2, fex_cali=2)


@query("k29_weight_chain_mean_rate", sql("""
SELECT estrato, count(*) AS n, round(sum(fep_aj), 3) AS fep_aj, round(sum(fex_cali), 3) AS fex_cali FROM final GROUP BY 1""",
    PANEL_FINAL))
def weight_chain_mean_rate(spark, sf):
    final = panel_plan.final_base(_scored(spark, sf, None), controls(spark, sf), "pobreza")
    sums = final.groupBy("estrato").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fep_aj").alias("fep_aj"), F.sum("fex_cali").alias("fex_cali")
    )
    return rounded(sums, fep_aj=3, fex_cali=3)


SPELLS = """
, o AS (SELECT id_hogar, id_pers, trimestre, trabajo AS estado FROM base),
r AS (SELECT *, substr(trimestre, 2, 1)::BIGINT
              - row_number() OVER (PARTITION BY id_hogar, id_pers, estado ORDER BY trimestre) AS corrida FROM o),
episodios AS (
  SELECT id_hogar, id_pers, estado, corrida, min(trimestre) AS desde, max(trimestre) AS hasta, count(*) AS duracion
  FROM r GROUP BY 1, 2, 3, 4)
"""


@query("k30_state_spells", sql("SELECT id_hogar, id_pers, estado, desde, hasta, duracion FROM episodios", SPELLS))
def spells(spark, sf):
    return state_spells(base(spark, sf), PERSON, "trabajo")


@query("k30_trajectories", sql("""
, u AS (SELECT id_hogar, id_pers, count(*) AS episodios, sum(duracion) AS periodos, max(duracion) AS larga FROM episodios GROUP BY 1, 2)
SELECT CASE WHEN episodios = 1 THEN 'estable' ELSE 'fluctuante' END AS trayectoria, CAST(periodos AS BIGINT) AS periodos,
       count(*) AS n, round(avg(larga), 9) AS duracion_media FROM u GROUP BY 1, 2""", SPELLS))
def stable_or_fluctuating(spark, sf):
    out = trajectories(state_spells(base(spark, sf), PERSON, "trabajo"), PERSON)
    return rounded(out, duracion_media=9)


# With one binary covariate the logit has a closed form, which SQL can state.
BY_SEX = """, s AS (
  SELECT count(*) FILTER (sexo = 'Hombre') AS n0, avg(CAST(respboth_per AS DOUBLE)) FILTER (sexo = 'Hombre') AS p0,
         count(*) FILTER (sexo = 'Mujer') AS n1, avg(CAST(respboth_per AS DOUBLE)) FILTER (sexo = 'Mujer') AS p1 FROM gente),
phi AS (SELECT sexo, avg(CAST(respboth_per AS DOUBLE)) AS prob_resp FROM gente GROUP BY 1)
"""


@query("k17_coefficient_table_by_sex", sql(
    """
SELECT '(Intercept)' AS term, round(ln(p0 / (1 - p0)), 5) AS estimate, round(sqrt(1 / (n0 * p0 * (1 - p0))), 5) AS se FROM s
UNION ALL
SELECT 'sexo_Mujer', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5),
       round(sqrt(1 / (n0 * p0 * (1 - p0)) + 1 / (n1 * p1 * (1 - p1))), 5) FROM s""", PANEL, BY_SEX))
def coefficients_by_sex(spark, sf):
    people = stored(_people(spark, sf))
    table = coefficients(fit_response(people, "respboth_per", ["sexo"]), people)
    return rounded(table.select("term", "estimate", "se"), estimate=5, se=5)


@query("k16_predicted_by_sex", sql(
    "SELECT id_hogar, id_pers, trimestre, round(prob_resp, 6) AS prob_resp FROM gente JOIN phi USING (sexo)", PANEL, BY_SEX))
def predicted_by_sex(spark, sf):
    return rounded(_scored(spark, sf, ["sexo"]).select(*PERSON, "trimestre", "prob_resp"), prob_resp=6)


@query("k19_adjusted_by_sex", sql(
    "SELECT id_hogar, id_pers, trimestre, round(fep_long / prob_resp, 4) AS fep_aj FROM gente JOIN phi USING (sexo)", PANEL, BY_SEX))
def adjusted_by_sex(spark, sf):
    return rounded(_scored(spark, sf, ["sexo"]).select(*PERSON, "trimestre", "fep_aj"), fep_aj=4)


@query("k29_weight_chain_by_sex", sql(
    """
, p AS (
  SELECT a.estrato, a.fep_long / prob_resp AS fep_aj FROM gente a JOIN phi USING (sexo) WHERE a.trimestre = 'T1' AND respboth_per = 1)
SELECT p.estrato, count(*) AS n, round(sum(fep_aj), 2) AS fep_aj, round(any_value(t_per), 2) AS fex_cali
FROM p JOIN metas m ON p.estrato = m.estrato GROUP BY 1""", PANEL, TARGETS, BY_SEX))
def weight_chain_by_sex(spark, sf):
    final = panel_plan.final_base(_scored(spark, sf, ["sexo"]), controls(spark, sf), "pobreza")
    sums = final.groupBy("estrato").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fep_aj").alias("fep_aj"), F.sum("fex_cali").alias("fex_cali")
    )
    return rounded(sums, fep_aj=2, fex_cali=2)
