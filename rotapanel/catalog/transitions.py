"""Gross flows, transition models and grouped functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.common import PANEL_FINAL, QUARTERLY_CAL, base, controls, covariance, quarterly, rounded, sql, variance
from rotapanel.catalog.registry import query
from rotapanel.catalog.reshaping import FLOW_SQL, STATES, _label_sql
from rotapanel.functions.reshape import dummies_wide, rename_matching
from rotapanel.operators.contrasts import contrast
from rotapanel.operators.flows import (
    allocate_by_weights, answered_both, column_complement, flow_counts, flow_table, flow_totals, flow_weights, labelled_matrix,
    net_and_gross, row_complement, total_with_error,
)
from rotapanel.operators.flow_errors import certificates, flow_errors, model_tests
from rotapanel.operators.longitudinal import PERSON, linked
from rotapanel.operators.markov import cell_arrays, exits_to, fit_flow_model, flow_standard_errors, goodness_of_fit
from rotapanel.operators.overlap import shared_units
from rotapanel.operators.statset import domain_means
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.session import stored
from rotapanel.sources.microdata import NO_ANSWER, POVERTY_LABELS

S1, S2, LEVELS = "pobreza_t1", "pobreza_t2", [1, 2, 3]


def _final(spark, sf):
    return panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")


def _cells(spark, sf):
    return flow_weights(_final(spark, sf), S1, S2, "fex_cali")


NAMED = f", nom AS (SELECT {_label_sql('pobreza_t1')} AS pobreza_t1, {_label_sql('pobreza_t2')} AS p2, fex_cali FROM final)"


@query("l1_transition_counts", sql(
    f"""SELECT s.estado AS pobreza_t1, {", ".join(f"count(p2) FILTER (p2 = '{x}') AS " + chr(34) + x + chr(34) for x in STATES)}
FROM (VALUES {", ".join(f"('{x}')" for x in STATES)}) s(estado) LEFT JOIN nom ON nom.pobreza_t1 = s.estado
GROUP BY 1""", PANEL_FINAL, NAMED))
def transition_counts(spark, sf):
    counts = flow_counts(_final(spark, sf), S1, S2, LEVELS)
    return labelled_matrix(counts, S1, S2, "n", POVERTY_LABELS, NO_ANSWER)


@query("l2_transition_totals", sql(
    """
SELECT a.pobreza_t1, a.pobreza_t2, round(t, 2) AS total, round(sqrt(v), 3) AS se
FROM (SELECT pobreza_t1, pobreza_t2, sum(fex_cali) AS t FROM final GROUP BY 1, 2) a
JOIN vf b ON a.pobreza_t1 IS NOT DISTINCT FROM b.pobreza_t1 AND a.pobreza_t2 IS NOT DISTINCT FROM b.pobreza_t2""",
    PANEL_FINAL, variance("final", ["pobreza_t1", "pobreza_t2"], "fex_cali", name="vf"),
))
def transition_totals(spark, sf):
    out = flow_totals(panel_plan.panel_design(_final(spark, sf)), S1, S2)
    return rounded(out.select(S1, S2, "total", "se"), total=2, se=3)


@query("l2_transition_totals_text", sql(
    f"""
SELECT {_label_sql('a.pobreza_t1')} AS desde, {_label_sql('a.pobreza_t2')} AS hacia,
       CAST(round_even(t, 0) AS BIGINT) || ' (' || CAST(round_even(sqrt(v), 0) AS BIGINT) || ')' AS total
FROM (SELECT pobreza_t1, pobreza_t2, sum(fex_cali) AS t FROM final GROUP BY 1, 2) a
JOIN vf b ON a.pobreza_t1 IS NOT DISTINCT FROM b.pobreza_t1 AND a.pobreza_t2 IS NOT DISTINCT FROM b.pobreza_t2""",
    PANEL_FINAL, variance("final", ["pobreza_t1", "pobreza_t2"], "fex_cali", name="vf"),
))
def transition_text(spark, sf):
    from rotapanel.functions.recode import label

    out = flow_totals(panel_plan.panel_design(_final(spark, sf)), S1, S2)
    return out.select(
        label(S1, POVERTY_LABELS, NO_ANSWER).alias("desde"), label(S2, POVERTY_LABELS, NO_ANSWER).alias("hacia"),
        total_with_error().alias("total"),
    )


@query("l3_both_answered_matrix", sql("""
SELECT pobreza_t1 AS state_1, count(*) FILTER (pobreza_t2 = 1) AS s_1, count(*) FILTER (pobreza_t2 = 2) AS s_2,
       count(*) FILTER (pobreza_t2 = 3) AS s_3
FROM final WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NOT NULL GROUP BY 1""", PANEL_FINAL))
def both_answered(spark, sf):
    from rotapanel.functions.reshape import to_wide

    known = answered_both(_cells(spark, sf))
    return to_wide(known, ["state_1"], "state_2", F.sum("n"), LEVELS, fill=0, prefix="s_")


@query("l4_row_complement", sql("""
SELECT pobreza_t1 AS state_1, count(*) AS complemento_fila FROM final WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NULL GROUP BY 1""",
    PANEL_FINAL))
def rows_lost(spark, sf):
    return row_complement(_cells(spark, sf), "n")


@query("l5_column_complement", sql("""
SELECT pobreza_t2 AS state_2, count(*) AS complemento_columna FROM final WHERE pobreza_t1 IS NULL AND pobreza_t2 IS NOT NULL GROUP BY 1""",
    PANEL_FINAL))
def columns_lost(spark, sf):
    return column_complement(_cells(spark, sf), "n")


@query("l6_flow_table_counts", sql(FLOW_SQL.format(v="count(*)", t="BIGINT", corner="b IS NULL"), PANEL_FINAL))
def flow_table_counts(spark, sf):
    return flow_table(_cells(spark, sf), "n", LEVELS)


@query("l7_flow_table_weighted", sql(
    "SELECT estado, round(s_1, 3) AS s_1, round(s_2, 3) AS s_2, round(s_3, 3) AS s_3, round(complemento_fila, 3) AS complemento_fila FROM tabla",
    PANEL_FINAL, ", tabla AS (WITH " + FLOW_SQL.format(v="sum(fex_cali)", t="DOUBLE", corner="b IS NULL").strip().lstrip(",") + ")",
))
def flow_table_weighted(spark, sf):
    out = flow_table(_cells(spark, sf), "w", LEVELS)
    return rounded(out, s_1=3, s_2=3, s_3=3, complemento_fila=3)


@query("l8_weight_difference_flows", sql("""
, e AS (SELECT a.trabajo AS s1, b.trabajo AS s2, a.fep AS w1, b.fep AS w2 FROM base a JOIN base b
  ON a.id_hogar = b.id_hogar AND a.id_pers = b.id_pers AND a.trimestre = 'T1' AND b.trimestre = 'T2'
  WHERE a.trabajo IS NOT NULL AND b.trabajo IS NOT NULL)
SELECT desde, hacia, sum(monto) AS monto FROM (
  SELECT s1 AS desde, s2 AS hacia, least(w1, w2) AS monto FROM e
  UNION ALL SELECT 'Fuera', s2, w2 - w1 FROM e WHERE w2 > w1
  UNION ALL SELECT s1, 'Fuera', w1 - w2 FROM e WHERE w1 > w2) GROUP BY 1, 2"""))
def weight_difference_flows(spark, sf):
    known = base(spark, sf, ["T1", "T2"]).where(F.col("trabajo").isNotNull())
    pairs = linked(known, "T1", "T2", {"s1": "trabajo", "w1": "fep"}, {"s2": "trabajo", "w2": "fep"})
    return allocate_by_weights(pairs, "s1", "s2", "w1", "w2")


@query("l9_net_and_gross_flows", sql("""
, k AS (SELECT pobreza_t1 AS a, pobreza_t2 AS b, count(*) AS v FROM final WHERE pobreza_t1 IS NOT NULL AND pobreza_t2 IS NOT NULL GROUP BY 1, 2)
SELECT estado, CAST(sum(v) FILTER (a = estado) AS BIGINT) AS margen_1, CAST(sum(v) FILTER (b = estado) AS BIGINT) AS margen_2,
       CAST(coalesce(sum(v) FILTER (b = estado AND a <> b), 0) AS BIGINT) AS entradas,
       CAST(coalesce(sum(v) FILTER (a = estado AND a <> b), 0) AS BIGINT) AS salidas,
       CAST(sum(v) FILTER (b = estado) - sum(v) FILTER (a = estado) AS BIGINT) AS cambio_neto
FROM k, (VALUES (1), (2), (3)) x(estado) GROUP BY 1""", PANEL_FINAL))
def net_and_gross_flows(spark, sf):
    return net_and_gross(_cells(spark, sf), "n")


def _fit(spark, sf, model: str = "C", by=None, zero_flows: bool = True):
    arrays = cell_arrays(_final(spark, sf), S1, S2, LEVELS, "fex_cali", by)
    return fit_flow_model(arrays, LEVELS, model, by, zero_flows)


def _param(spark, sf, *names: str):
    fit = _fit(spark, sf).where(F.col("param").isin(*names))
    return rounded(fit.drop("iterations"), value=6)


@query("l10_markov_parameters")
def markov_parameters(spark, sf):
    return _param(spark, sf, "eta", "pij")


@query("l11_response_process")
def response_process(spark, sf):
    return _param(spark, sf, "psi", "rho_rr", "rho_mm")


@query("l12_fit_model_c")
def fit_model_c(spark, sf):
    return rounded(_fit(spark, sf).drop("iterations"), value=6)


@query("l13_models_a_to_d")
def models(spark, sf):
    arrays = stored(cell_arrays(_final(spark, sf), S1, S2, LEVELS, "fex_cali"))
    out = None
    for model in "ABCD":
        fit = fit_flow_model(arrays, LEVELS, model).drop("iterations").withColumn("modelo", F.lit(model))
        out = fit if out is None else out.unionByName(fit)
    return rounded(out, value=6)


@query("l14_eta")
def eta(spark, sf):
    return _param(spark, sf, "eta")


@query("l15_gamma")
def gamma(spark, sf):
    return _param(spark, sf, "gamma")


@query("l16_transition_matrix")
def transition_matrix(spark, sf):
    return _param(spark, sf, "pij")


@query("l17_population_flows")
def population_flows(spark, sf):
    return rounded(_fit(spark, sf).where(F.col("param") == "muij").drop("iterations"), value=2)


@query("l18_response_parameters_with_error")
def response_parameters(spark, sf):
    return _with_errors(spark, sf).where(F.col("param").isin("psi", "rho_rr", "rho_mm"))


def _with_errors(spark, sf):
    design = panel_plan.panel_design(stored(_final(spark, sf)))
    return rounded(flow_standard_errors(design, S1, S2, LEVELS), value=4, se=4)


@query("l19_parameters_with_error")
def parameters_with_error(spark, sf):
    return _with_errors(spark, sf)


@query("l20_goodness_of_fit")
def model_choice(spark, sf):
    out = goodness_of_fit(panel_plan.panel_design(_final(spark, sf)), S1, S2, LEVELS)
    return rounded(out.drop("iterations"), chi2=4, deff=4, chi2_rs=4, critical=4, p=6)


@query("l21_fit_by_sex")
def fit_by_sex(spark, sf):
    return rounded(_fit(spark, sf, by=["sexo"]).drop("iterations"), value=6)


@query("l22_structural_zero_flows")
def structural_zeros(spark, sf):
    fixed = _fit(spark, sf, by=["sexo"]).where(F.col("param") == "pij").select("sexo", "i", "j", F.col("value").alias("fijo"))
    free = _fit(spark, sf, by=["sexo"], zero_flows=False).where(F.col("param") == "pij").select(
        "sexo", "i", "j", F.col("value").alias("libre")
    )
    return rounded(fixed.join(free, ["sexo", "i", "j"]), fijo=6, libre=6)


@query("l23_exits_by_sex")
def exits_by_sex(spark, sf):
    return rounded(exits_to(_fit(spark, sf, by=["sexo"]), "1", "sexo"), Hombre=6, Mujer=6)


@query("m1_grouped_calibration", sql("""
SELECT trimestre, count(*) AS hogares, round(sum(dk_mes_cali), 3) AS total FROM hogcal GROUP BY 1""", QUARTERLY_CAL))
def grouped_calibration(spark, sf):
    homes = quarterly_plan.calibrated_households(quarterly(spark, sf), controls(spark, sf))
    return homes.groupBy("trimestre").agg(
        F.count(F.lit(1)).alias("hogares"), F.round(F.sum("dk_mes_cali"), 3).alias("total")
    )


@query("m2_pairs_of_list", sql("""
SELECT a.trimestre AS trimestre_1, b.trimestre AS trimestre_2, count(*) AS traslape
FROM (SELECT DISTINCT id_hogar, id_pers, trimestre FROM base) a JOIN (SELECT DISTINCT id_hogar, id_pers, trimestre FROM base) b
  ON a.id_hogar = b.id_hogar AND a.id_pers = b.id_pers AND a.trimestre < b.trimestre GROUP BY 1, 2"""))
def pairs_of_list(spark, sf):
    return shared_units(base(spark, sf), PERSON)


@query("m3_rename_function", sql("""
SELECT trimestre AS col_trimestre, count(*) AS col_n FROM base GROUP BY 1"""))
def rename_function(spark, sf):
    counts = base(spark, sf).groupBy("trimestre").agg(F.count(F.lit(1)).alias("n"))
    return rename_matching(counts, "^", "col_")


@query("m4_quoted_contrast", sql(
    """
, med AS (SELECT trimestre, sum(dk_mes_cali * ingreso) / sum(dk_mes_cali) AS m FROM cali GROUP BY 1)
SELECT 'semestres' AS stat,
       round((sum(m) FILTER (trimestre IN ('T3', 'T4')) - sum(m) FILTER (trimestre IN ('T1', 'T2'))) / 2, 5) AS estimate FROM med""",
    QUARTERLY_CAL))
def quoted_contrast(spark, sf):
    design = quarterly_plan.quarterly_design(base(spark, sf), controls(spark, sf))
    quarters = {q: F.col("trimestre") == q for q in ("T1", "T2", "T3", "T4")}
    stats = domain_means(design, F.col("ingreso"), quarters)
    out = contrast(stats, {"T1": -0.5, "T2": -0.5, "T3": 0.5, "T4": 0.5}, "semestres")
    return rounded(out.select("stat", "estimate"), estimate=5)


@query("m5_across_function", sql("""
SELECT trimestre, sum(fep * CASE WHEN area = '1' THEN 1 ELSE 0 END) AS area_1, sum(fep * CASE WHEN area = '2' THEN 1 ELSE 0 END) AS area_2
FROM base GROUP BY 1"""))
def across_function(spark, sf):
    wide = dummies_wide(base(spark, sf), "area", ["1", "2"], "area_")
    return wide.groupBy("trimestre").agg(*[F.sum(F.col("fep") * F.col(c)).alias(c) for c in ("area_1", "area_2")])


def _domain_cells(domain: str) -> str:
    return f", celda AS (SELECT {domain} AS d, pobreza_t1 AS a, pobreza_t2 AS b, sum(fex_cali) AS w FROM final GROUP BY 1, 2, 3)"


def _model_a_sql(domain: str = "", cells: str = "") -> str:
    """Model A in SQL: EM over the joint probabilities, response probabilities in closed form."""
    return (cells or _domain_cells(domain)) + """,
dom AS (SELECT d, sum(w) AS t, sum(w) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, sum(w) FILTER (a IS NOT NULL AND b IS NULL) AS r,
               sum(w) FILTER (a IS NULL AND b IS NOT NULL) AS c, sum(w) FILTER (a IS NULL AND b IS NULL) AS m FROM celda GROUP BY 1),
tabla AS (
  SELECT dom.d, x.a, y.b, t, m, coalesce((SELECT w FROM celda k WHERE k.d = dom.d AND k.a = x.a AND k.b = y.b), 0) AS n,
         (SELECT w FROM celda k WHERE k.d = dom.d AND k.a = x.a AND k.b IS NULL) AS r,
         (SELECT w FROM celda k WHERE k.d = dom.d AND k.a IS NULL AND k.b = y.b) AS c
  FROM dom CROSS JOIN (VALUES (1), (2), (3)) x(a) CROSS JOIN (VALUES (1), (2), (3)) y(b)),
em AS (
  WITH RECURSIVE pasos(it, d, a, b, f) AS (
    SELECT 0, d, a, b, 1 / 9.0::DOUBLE FROM tabla
    UNION ALL
    SELECT it + 1, e.d, e.a, e.b,
           (n + r * f / sum(f) OVER (PARTITION BY e.d, e.a) + c * f / sum(f) OVER (PARTITION BY e.d, e.b) + m * f / sum(f) OVER (PARTITION BY e.d)) / t
    FROM pasos e JOIN tabla q ON e.d = q.d AND e.a = q.a AND e.b = q.b WHERE it < 60)
  SELECT d, a, b, f FROM pasos WHERE it = 60),
pars AS (
  SELECT d, 'eta' AS param, CAST(a AS VARCHAR) AS i, CAST(NULL AS VARCHAR) AS j, sum(f) AS value FROM em GROUP BY 1, a
  UNION ALL SELECT d, 'gamma', NULL, CAST(b AS VARCHAR), sum(f) FROM em GROUP BY 1, b
  UNION ALL SELECT d, 'pij', CAST(a AS VARCHAR), CAST(b AS VARCHAR), f / sum(f) OVER (PARTITION BY d, a) FROM em
  UNION ALL SELECT d, 'muij', CAST(a AS VARCHAR), CAST(b AS VARCHAR), f * t FROM em JOIN dom USING (d)
  UNION ALL SELECT d, 'psi', NULL, NULL, (n + r) / t FROM dom
  UNION ALL SELECT d, 'rho_rr', NULL, NULL, n / (n + r) FROM dom
  UNION ALL SELECT d, 'rho_mm', NULL, NULL, m / (c + m) FROM dom)
"""


@query("l12_fit_model_a", sql(
    "SELECT param, i, j, round(value, 4) AS value FROM pars", PANEL_FINAL, _model_a_sql("'all'")))
def fit_model_a(spark, sf):
    return rounded(_fit(spark, sf, "A").select("param", "i", "j", "value"), value=4)


@query("l21_fit_model_a_by_sex", sql(
    "SELECT d AS sexo, param, i, j, round(value, 4) AS value FROM pars", PANEL_FINAL, _model_a_sql("sexo")))
def fit_model_a_by_sex(spark, sf):
    return rounded(_fit(spark, sf, "A", ["sexo"]).select("sexo", "param", "i", "j", "value"), value=4)


@query("l23_exits_by_sex_model_a", sql(
    """
SELECT i, round(max(value) FILTER (d = 'Hombre'), 6) AS "Hombre", round(max(value) FILTER (d = 'Mujer'), 6) AS "Mujer"
FROM pars WHERE param = 'pij' AND j = '1' GROUP BY 1""", PANEL_FINAL, _model_a_sql("sexo")))
def exits_by_sex_model_a(spark, sf):
    return rounded(exits_to(_fit(spark, sf, "A", ["sexo"]), "1", "sexo"), Hombre=6, Mujer=6)


# In model C the answers of the first round and of those who went on are plain shares.
@query("l11_first_round_response", sql("""
SELECT 'psi' AS param, CAST(NULL AS VARCHAR) AS i, round(sum(fex_cali) FILTER (pobreza_t1 IS NOT NULL) / sum(fex_cali), 6) AS value FROM final
UNION ALL
SELECT 'rho_rr', CAST(pobreza_t1 AS VARCHAR), round(sum(fex_cali) FILTER (pobreza_t2 IS NOT NULL) / sum(fex_cali), 6)
FROM final WHERE pobreza_t1 IS NOT NULL GROUP BY pobreza_t1""", PANEL_FINAL))
def first_round_response(spark, sf):
    fit = _fit(spark, sf).where(F.col("param").isin("psi", "rho_rr"))
    return rounded(fit.select("param", "i", "value"), value=6)


# One table of cells per unit left out, and one for the whole sample.
LEFT_OUT = """, u AS (SELECT estrato, upm, pobreza_t1 AS a, pobreza_t2 AS b, sum(fex_cali) AS w FROM final GROUP BY 1, 2, 3, 4),
uni AS (SELECT estrato, upm, count(*) OVER (PARTITION BY estrato) AS n FROM (SELECT DISTINCT estrato, upm FROM final)),
celda AS (
  SELECT r.estrato || ':' || r.upm AS d, u.a, u.b,
         sum(u.w * CASE WHEN u.estrato <> r.estrato THEN 1.0::DOUBLE WHEN u.upm = r.upm THEN 0 ELSE n / (n - 1.0::DOUBLE) END) AS w
  FROM uni r CROSS JOIN u GROUP BY 1, 2, 3
  UNION ALL SELECT 'all', a, b, sum(w) FROM u GROUP BY a, b)"""
DEVIATIONS = """, peso AS (SELECT estrato || ':' || upm AS d, (n - 1.0::DOUBLE) / n AS k FROM uni),
errores AS (
  SELECT x.param, x.i, x.j, any_value(x.value) AS value, sqrt(sum(k * (p.value - x.value) * (p.value - x.value))) AS se
  FROM pars x JOIN pars p ON x.param = p.param AND x.i IS NOT DISTINCT FROM p.i AND x.j IS NOT DISTINCT FROM p.j
  JOIN peso ON peso.d = p.d WHERE x.d = 'all' GROUP BY 1, 2, 3)
"""


@query("l19_model_a_with_error", sql(
    "SELECT param, i, j, round(value, 3) AS value, round(se, 3) AS se, true AS converged FROM errores WHERE param <> 'muij'",
    PANEL_FINAL, _model_a_sql(cells=LEFT_OUT), DEVIATIONS))
def model_a_with_error(spark, sf):
    design = panel_plan.panel_design(stored(_final(spark, sf)))
    errors = flow_standard_errors(design, S1, S2, LEVELS, "A").where(F.col("param") != "muij")
    return rounded(errors, value=3, se=3)


@query("l17_model_a_flows_with_error", sql(
    "SELECT i, j, round(value, 1) AS value, round(se, 1) AS se FROM errores WHERE param = 'muij'",
    PANEL_FINAL, _model_a_sql(cells=LEFT_OUT), DEVIATIONS))
def model_a_flows(spark, sf):
    design = panel_plan.panel_design(stored(_final(spark, sf)))
    errors = flow_standard_errors(design, S1, S2, LEVELS, "A").where(F.col("param") == "muij")
    return rounded(errors.select("i", "j", "value", "se"), value=1, se=1)


# In model C, psi and rho_RR are shares of the cells in every replicate too.
SHARES_C = """, pars AS (
  SELECT d, 'psi' AS param, CAST(NULL AS VARCHAR) AS i, CAST(NULL AS VARCHAR) AS j,
         sum(w) FILTER (a IS NOT NULL) / sum(w) AS value FROM celda GROUP BY 1
  UNION ALL
  SELECT d, 'rho_rr', CAST(a AS VARCHAR), NULL, sum(w) FILTER (b IS NOT NULL) / sum(w) FROM celda WHERE a IS NOT NULL GROUP BY d, a)
"""


@query("l18_first_round_response_with_error", sql(
    "SELECT param, i, round(value, 5) AS value, round(se, 5) AS se FROM errores", PANEL_FINAL, LEFT_OUT, SHARES_C, DEVIATIONS))
def first_round_response_with_error(spark, sf):
    design = panel_plan.panel_design(stored(_final(spark, sf)))
    errors = flow_standard_errors(design, S1, S2, LEVELS, "C").where(F.col("param").isin("psi", "rho_rr"))
    return rounded(errors.select("param", "i", "value", "se"), value=5, se=5)


GOODNESS = """, proporciones AS (
  SELECT coalesce(CAST(pobreza_t1 AS VARCHAR), '-') || '>' || coalesce(CAST(pobreza_t2 AS VARCHAR), '-') AS stat,
         pobreza_t1 AS a, pobreza_t2 AS b, sum(fex_cali) / (SELECT sum(fex_cali) FROM final) AS p FROM final GROUP BY 1, 2, 3),
totu AS (SELECT estrato, upm, sum(fex_cali) AS s FROM final GROUP BY 1, 2),
zu AS (
  SELECT estrato, upm, coalesce(CAST(pobreza_t1 AS VARCHAR), '-') || '>' || coalesce(CAST(pobreza_t2 AS VARCHAR), '-') AS stat,
         sum(fex_cali) AS z FROM final GROUP BY 1, 2, 3),
zc AS (
  SELECT t.estrato, t.upm, p.stat, (coalesce(z.z, 0) - p.p * s) / (SELECT sum(fex_cali) FROM final) AS z
  FROM totu t CROSS JOIN proporciones p LEFT JOIN zu z ON z.estrato = t.estrato AND z.upm = t.upm AND z.stat = p.stat),
""" + covariance("final", "zc").lstrip().lstrip(",") + """, par AS (
  SELECT max(value) FILTER (param = 'psi') AS psi, max(value) FILTER (param = 'rho_rr') AS rr, max(value) FILTER (param = 'rho_mm') AS mm FROM pars),
esperado AS (
  SELECT a, b, psi * rr * f AS e FROM em, par
  UNION ALL SELECT a, NULL, psi * (1 - rr) * sum(f) FROM em, par GROUP BY a, psi, rr
  UNION ALL SELECT NULL, b, (1 - psi) * (1 - mm) * sum(f) FROM em, par GROUP BY b, psi, mm
  UNION ALL SELECT NULL, NULL, (1 - psi) * mm FROM par),
ajuste AS (
  SELECT (SELECT count(*) FROM final) * sum((p - e) * (p - e) / e) AS chi2,
         (SELECT count(*) FROM final) * sum(cov / p) / (count(*) - 1) AS deff
  FROM proporciones p JOIN esperado x ON p.a IS NOT DISTINCT FROM x.a AND p.b IS NOT DISTINCT FROM x.b
  JOIN vc ON stat_a = stat AND stat_b = stat)
"""


@query("l20_goodness_of_fit_model_a", sql(
    """
SELECT 'A' AS model, round(chi2, 4) AS chi2, round(deff, 4) AS deff, round(chi2 / deff, 4) AS chi2_rs, 5 AS df, 11.0705::DOUBLE AS critical,
       round(1 - (SELECT sum(exp(2.5 * ln(chi2 / deff / 2) - chi2 / deff / 2 + k * ln(chi2 / deff / 2) - lgamma(k + 3.5))) FROM range(400) s(k)), 6) AS p
FROM ajuste""",
    PANEL_FINAL, _model_a_sql("'all'"), GOODNESS))
def goodness_model_a(spark, sf):
    out = goodness_of_fit(panel_plan.panel_design(_final(spark, sf)), S1, S2, LEVELS, ["A"])
    return rounded(out.drop("iterations", "converged"), chi2=4, deff=4, chi2_rs=4, critical=4, p=6)


# Model A's parameters move with the weight of a cell (ua, ub) as EM does: its steps are differentiated and iterated.
INFLUENCE_A = """, par AS (
  SELECT d, max(value) FILTER (param = 'psi') AS psi, max(value) FILTER (param = 'rho_rr') AS rr, max(value) FILTER (param = 'rho_mm') AS mm
  FROM pars GROUP BY 1),
rumbo AS (SELECT x AS ua, y AS ub FROM range(0, 4) s(x) CROSS JOIN range(0, 4) q(y)),
fijo AS (
  SELECT q.*, f, sum(f) OVER (PARTITION BY d, a) AS fi, sum(f) OVER (PARTITION BY d, b) AS fj FROM tabla q JOIN em USING (d, a, b)),
mueve AS (
  WITH RECURSIVE pasos(it, d, ua, ub, a, b, df) AS (
    SELECT 0, d, ua, ub, a, b, 0::DOUBLE FROM fijo CROSS JOIN rumbo
    UNION ALL
    SELECT it + 1, e.d, e.ua, e.ub, e.a, e.b,
           ((ua = a AND ub = b)::INT + (ua = a AND ub = 0)::INT * f / fi + (ua = 0 AND ub = b)::INT * f / fj + (ua = 0 AND ub = 0)::INT * f
            + r * (df - f / fi * sum(df) OVER (PARTITION BY e.d, ua, ub, e.a)) / fi
            + c * (df - f / fj * sum(df) OVER (PARTITION BY e.d, ua, ub, e.b)) / fj
            + m * (df - f * sum(df) OVER (PARTITION BY e.d, ua, ub)) - f) / t
    FROM pasos e JOIN fijo USING (d, a, b) WHERE it < 60)
  SELECT d, ua, ub, a, b, f, fi, t, df, sum(df) OVER (PARTITION BY d, ua, ub, a) AS dfi, sum(df) OVER (PARTITION BY d, ua, ub, b) AS dfj
  FROM pasos JOIN fijo USING (d, a, b) WHERE it = 60),
responde AS (
  SELECT d, ua, ub, t, psi, rr, mm, ((ua > 0)::INT - psi) / t AS dpsi, CASE WHEN ua > 0 THEN ((ub > 0)::INT - rr) / (n + r) ELSE 0 END AS drr,
         CASE WHEN ua = 0 THEN ((ub = 0)::INT - mm) / (c + m) ELSE 0 END AS dmm
  FROM dom JOIN par USING (d) CROSS JOIN rumbo),
grad AS (
  SELECT d, ua, ub, 'eta' AS param, CAST(a AS VARCHAR) AS i, '-' AS j, any_value(dfi) AS v FROM mueve GROUP BY d, ua, ub, a
  UNION ALL SELECT d, ua, ub, 'gamma', '-', CAST(b AS VARCHAR), any_value(dfj) FROM mueve GROUP BY d, ua, ub, b
  UNION ALL SELECT d, ua, ub, 'pij', CAST(a AS VARCHAR), CAST(b AS VARCHAR), (df - f / fi * dfi) / fi FROM mueve
  UNION ALL SELECT d, ua, ub, 'muij', CAST(a AS VARCHAR), CAST(b AS VARCHAR), t * df + f FROM mueve
  UNION ALL SELECT d, ua, ub, 'psi', '-', '-', dpsi FROM responde
  UNION ALL SELECT d, ua, ub, 'rho_rr', '-', '-', drr FROM responde
  UNION ALL SELECT d, ua, ub, 'rho_mm', '-', '-', dmm FROM responde)
"""


def _linear_errors(domain: str, residual: bool = False) -> str:
    """WITH entry ``errores_l``: variances of the linearised parameters, of residuals per stratum for calibrated weights."""
    slope = "sum(b) OVER p / sum(peso_base) OVER p * peso" if residual else "0"
    return f""", porunidad AS (
  SELECT estrato, upm, {domain} AS d, coalesce(pobreza_t1, 0) AS ua, coalesce(pobreza_t2, 0) AS ub, sum(fex_cali) AS w, sum(fep_aj) AS base
  FROM final GROUP BY ALL),
lineal AS (
  SELECT estrato, upm, d, param, i, j, sum(w * v) AS z, sum(base * v) AS b FROM porunidad JOIN grad USING (d, ua, ub) GROUP BY ALL),
unidades AS (SELECT estrato, upm, sum(fex_cali) AS peso, sum(fep_aj) AS peso_base, count(*) OVER (PARTITION BY estrato) AS n FROM final GROUP BY 1, 2),
completo AS (
  SELECT u.*, g.*, coalesce(z, 0) AS z, coalesce(b, 0) AS b
  FROM unidades u CROSS JOIN (SELECT DISTINCT d, param, i, j FROM grad) g LEFT JOIN lineal l USING (estrato, upm, d, param, i, j)),
residuo AS (SELECT *, z - {slope} AS e FROM completo WINDOW p AS (PARTITION BY estrato, d, param, i, j)),
porestrato AS (
  SELECT d, param, i, j, CASE WHEN any_value(n) > 1 THEN any_value(n) / (any_value(n) - 1.0::DOUBLE) * (sum(e * e) - sum(e) * sum(e) / any_value(n))
         ELSE 0 END AS v FROM residuo GROUP BY estrato, d, param, i, j),
errores_l AS (SELECT d, param, i, j, sqrt(sum(v)) AS se FROM porestrato GROUP BY 1, 2, 3, 4)
"""


ERRORS_L = """
SELECT x.d AS sexo, x.param, x.i, x.j, round(value, 3) AS value, round(se, 4) AS se
FROM pars x JOIN errores_l e ON x.d = e.d AND x.param = e.param AND coalesce(x.i, '-') = e.i AND coalesce(x.j, '-') = e.j"""


def _linear(spark, sf, models, by=None, residual=False):
    return flow_errors(panel_plan.panel_design(_final(spark, sf), residual), S1, S2, LEVELS, models, by)


@query("l19_linearised_errors_by_sex", sql(ERRORS_L, PANEL_FINAL, _model_a_sql("sexo"), INFLUENCE_A, _linear_errors("sexo")))
def linearised_errors(spark, sf):
    out = _linear(spark, sf, ["A"], ["sexo"]).select("sexo", "param", "i", "j", "value", "se")
    return rounded(out, value=3, se=4)


@query("l17_errors_of_calibrated_weights", sql(
    ERRORS_L, PANEL_FINAL, _model_a_sql("'todos'"), INFLUENCE_A, _linear_errors("'todos'", residual=True)))
def errors_of_calibrated_weights(spark, sf):
    out = _linear(spark, sf, ["A"], residual=True).select(F.lit("todos").alias("sexo"), "param", "i", "j", "value", "se")
    return rounded(out, value=3, se=4)


@query("l19_errors_of_all_models")
def errors_of_all_models(spark, sf):
    return rounded(_linear(spark, sf, list("ABCD"), ["sexo"]), value=5, se=5)


# Residual shares of model A's cells are linear in the weights too; their covariances give the design effects.
RESIDUALS_A = INFLUENCE_A + """, persona AS (SELECT sexo AS d, count(*) AS personas FROM final GROUP BY 1),
celda_p AS (
  SELECT d, coalesce(a, 0) AS a, coalesce(b, 0) AS b, w / t AS p FROM celda JOIN dom USING (d)),
celda_e AS (
  SELECT d, a, b, psi * rr * f AS e FROM fijo JOIN par USING (d)
  UNION ALL SELECT d, a, 0, any_value(psi * (1 - rr) * fi) FROM fijo JOIN par USING (d) GROUP BY d, a
  UNION ALL SELECT d, 0, b, any_value((1 - psi) * (1 - mm) * fj) FROM fijo JOIN par USING (d) GROUP BY d, b
  UNION ALL SELECT d, 0, 0, (1 - psi) * mm FROM par),
cambia AS (
  SELECT d, ua, ub, a, b, dpsi * rr * f + psi * drr * f + psi * rr * df AS v FROM mueve JOIN responde USING (d, ua, ub)
  UNION ALL SELECT d, ua, ub, a, 0, any_value(dpsi * (1 - rr) * fi - psi * drr * fi + psi * (1 - rr) * dfi)
    FROM mueve JOIN responde USING (d, ua, ub) GROUP BY d, ua, ub, a
  UNION ALL SELECT d, ua, ub, 0, b, any_value(-dpsi * (1 - mm) * fj - (1 - psi) * dmm * fj + (1 - psi) * (1 - mm) * dfj)
    FROM (SELECT m.*, fj FROM mueve m JOIN fijo USING (d, a, b)) JOIN responde USING (d, ua, ub) GROUP BY d, ua, ub, b
  UNION ALL SELECT d, ua, ub, 0, 0, -dpsi * mm + (1 - psi) * dmm FROM responde),
resto AS (
  SELECT c.d, ua, ub, a || '.' || b AS stat, ((ua = a AND ub = b)::INT - coalesce(p, 0)) / t - v AS v, e
  FROM cambia c JOIN celda_e USING (d, a, b) LEFT JOIN celda_p USING (d, a, b) JOIN dom ON dom.d = c.d),
zr AS (
  SELECT estrato, upm, d, stat, sum(w * v) AS z
  FROM (SELECT estrato, upm, sexo AS d, coalesce(pobreza_t1, 0) AS ua, coalesce(pobreza_t2, 0) AS ub, sum(fex_cali) AS w FROM final GROUP BY ALL)
  JOIN resto USING (d, ua, ub) GROUP BY ALL),
ur AS (SELECT estrato, upm, count(*) OVER (PARTITION BY estrato) AS n FROM final GROUP BY 1, 2),
cr AS (
  SELECT estrato, upm, d, stat, n, coalesce(z, 0) - avg(coalesce(z, 0)) OVER (PARTITION BY estrato, d, stat) AS x
  FROM ur CROSS JOIN (SELECT DISTINCT d, stat FROM resto) LEFT JOIN zr USING (estrato, upm, d, stat)),
vr AS (
  SELECT a.d, a.stat AS sa, b.stat AS sb, sum(CASE WHEN a.n > 1 THEN a.n / (a.n - 1.0::DOUBLE) * a.x * b.x ELSE 0 END) AS cov
  FROM cr a JOIN cr b USING (estrato, upm, d) GROUP BY 1, 2, 3),
efectos AS (
  SELECT vr.d, sum(personas * cov / x.e) FILTER (sa = sb) AS s1, sum(personas * personas * cov * cov / x.e / y.e) AS s2
  FROM vr JOIN (SELECT DISTINCT d, stat, e FROM resto) x ON x.d = vr.d AND x.stat = sa JOIN (SELECT DISTINCT d, stat, e FROM resto) y
    ON y.d = vr.d AND y.stat = sb JOIN persona ON persona.d = vr.d GROUP BY 1),
pearson AS (
  SELECT d, personas, personas * sum((coalesce(p, 0) - e) * (coalesce(p, 0) - e) / e) AS chi2
  FROM celda_e LEFT JOIN celda_p USING (d, a, b) JOIN persona USING (d) GROUP BY 1, 2),
segundo AS (SELECT *, chi2 * s1 / s2 / 2 AS x, s1 * s1 / s2 / 2 AS s FROM pearson JOIN efectos USING (d))
"""


@query("l20_second_order_by_sex", sql("""
SELECT d AS sexo, 'A' AS model, round(chi2, 4) AS chi2, 4 AS df, round(s1 / 4, 4) AS deff, round(2 * x, 4) AS chi2_rs, round(2 * s, 4) AS df_rs,
       round(1 - (SELECT sum(exp((s + k) * ln(x) - x - lgamma(s + k + 1))) FROM range(400) q(k)), 6) AS p, personas AS n
FROM segundo""", PANEL_FINAL, _model_a_sql("sexo"), RESIDUALS_A))
def second_order_tests(spark, sf):
    out = model_tests(panel_plan.panel_design(_final(spark, sf)), S1, S2, LEVELS, ["A"], ["sexo"])
    return rounded(out.drop("critical", "converged", "chosen"), chi2=4, deff=4, chi2_rs=4, df_rs=4, p=6)


@query("l20_chosen_model_by_sex")
def chosen_model(spark, sf):
    out = model_tests(panel_plan.panel_design(_final(spark, sf)), S1, S2, LEVELS, by=["sexo"])
    return rounded(out, chi2=4, deff=4, chi2_rs=4, df_rs=4, critical=4, p=6)


# SQL reaches a likelihood near the best one by many plain EM steps; at the fit every slope is 0 or points out of bounds.
AXES_SQL = {"B": ("PARTITION BY d, a", "PARTITION BY d", "PARTITION BY d"), "C": ("PARTITION BY d", "PARTITION BY d, a", "PARTITION BY d, a"),
            "D": ("PARTITION BY d", "PARTITION BY d, b", "PARTITION BY d, b")}
EM_STEPS = {"B": 6000, "C": 6000, "D": 6000}


def _em_sql(model: str) -> str:
    psi, rr, mm = AXES_SQL[model]
    return f""", em_{model} AS (
  WITH RECURSIVE pasos(it, d, a, b, f, psi, rr, mm) AS (
    SELECT 0, d, a, b, 1 / 9.0::DOUBLE, 0.9::DOUBLE, 0.9::DOUBLE, 0.5::DOUBLE FROM tabla
    UNION ALL
    SELECT it + 1, d, a, b, todos / sum(todos) OVER (PARTITION BY d), sum(contesta) OVER ({psi}) / sum(todos) OVER ({psi}),
           sum(n) OVER ({rr}) / sum(contesta) OVER ({rr}), sum(nunca) OVER ({mm}) / sum(calla) OVER ({mm})
    FROM (SELECT *, n + fila AS contesta, col + nunca AS calla, n + fila + col + nunca AS todos FROM (
      SELECT it, e.d, e.a, e.b, n, r * psi * (1 - rr) * f / sum(psi * (1 - rr) * f) OVER (PARTITION BY e.d, e.a) AS fila,
             c * (1 - psi) * (1 - mm) * f / sum((1 - psi) * (1 - mm) * f) OVER (PARTITION BY e.d, e.b) AS col,
             m * (1 - psi) * mm * f / sum((1 - psi) * mm * f) OVER (PARTITION BY e.d) AS nunca
      FROM pasos e JOIN tabla q ON e.d = q.d AND e.a = q.a AND e.b = q.b WHERE it < {EM_STEPS[model]})))
  SELECT * FROM pasos WHERE it = {EM_STEPS[model]}),
log_{model} AS (
  SELECT d, '{model}' AS model, (sum(l) + any_value(m * ln(nada))) / any_value(t) AS loglik FROM (
    SELECT d, t, m, n * ln(psi * rr * f) + r / 3 * ln(sum(psi * (1 - rr) * f) OVER (PARTITION BY d, a))
           + c / 3 * ln(sum((1 - psi) * (1 - mm) * f) OVER (PARTITION BY d, b)) AS l, sum((1 - psi) * mm * f) OVER (PARTITION BY d) AS nada
    FROM em_{model} JOIN tabla USING (d, a, b)) GROUP BY d)
"""


CERTIFICATE = """
SELECT d AS sexo, model, round(loglik, 4) AS loglik, 9 + CASE model WHEN 'B' THEN 5 ELSE 7 END AS n_params, true AS holds
FROM (SELECT * FROM log_B UNION ALL SELECT * FROM log_C UNION ALL SELECT * FROM log_D)"""


def _certified(spark, sf, by):
    arrays = cell_arrays(_final(spark, sf), S1, S2, LEVELS, "fex_cali", by)
    return certificates(arrays, LEVELS, ["B", "C", "D"], by)


@query("l12_certificate_by_sex", sql(CERTIFICATE, PANEL_FINAL, _model_a_sql("sexo"), _em_sql("B"), _em_sql("C"), _em_sql("D")))
def certificate_by_sex(spark, sf):
    rows = _certified(spark, sf, ["sexo"]).groupBy("sexo", "model")
    out = rows.agg(F.first("loglik").alias("loglik"), F.count("*").cast("int").alias("n_params"), F.bool_and("holds").alias("holds"))
    return rounded(out, loglik=4)


# Weights of a stratum that lost a unit are calibrated again to the stratum's total.
LEFT_OUT_CALIBRATED = """, u AS (SELECT estrato, upm, pobreza_t1 AS a, pobreza_t2 AS b, sum(fex_cali) AS w FROM final GROUP BY 1, 2, 3, 4),
uni AS (SELECT estrato, upm, sum(fex_cali) AS suya, sum(sum(fex_cali)) OVER (PARTITION BY estrato) AS toda, count(*) OVER (PARTITION BY estrato) AS n
        FROM final GROUP BY 1, 2),
celda AS (
  SELECT r.estrato || ':' || r.upm AS d, u.a, u.b,
         sum(u.w * CASE WHEN u.estrato <> r.estrato THEN 1.0::DOUBLE WHEN u.upm = r.upm THEN 0 ELSE toda / (toda - suya) END) AS w
  FROM uni r CROSS JOIN u GROUP BY 1, 2, 3
  UNION ALL SELECT 'all', a, b, sum(w) FROM u GROUP BY a, b)"""


@query("l19_jackknife_of_calibrated_weights", sql(
    "SELECT param, i, j, round(value, 3) AS value, round(se, 4) AS se, true AS converged FROM errores WHERE param <> 'muij'",
    PANEL_FINAL, _model_a_sql(cells=LEFT_OUT_CALIBRATED), DEVIATIONS))
def jackknife_of_calibrated_weights(spark, sf):
    design = panel_plan.panel_design(stored(_final(spark, sf)), residual=True)
    errors = flow_standard_errors(design, S1, S2, LEVELS, "A").where(F.col("param") != "muij")
    return rounded(errors, value=3, se=4)
