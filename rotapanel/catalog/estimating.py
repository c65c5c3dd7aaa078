"""Design-based estimation, contrasts and tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from rotapanel.catalog.calibrating import MARGINS_SQL, margin_terms, margin_totals
from rotapanel.catalog.common import (
    ANNUAL_CAL, PANEL_FINAL, QUARTERLY_CAL, base, controls, covariance, rounded, sql, t_points, t_within, variance,
)
from rotapanel.catalog.registry import query
from rotapanel.functions.distributions import t_point
from rotapanel.functions.recode import cv, in_labour_force, unemployed
from rotapanel.operators.calibration import calibrate
from rotapanel.operators.contrasts import (
    change_variance, contrast, covariance_between, design_t_test, mean_of_three_variance, moving_rates, net_change,
    weighted_correlation,
)
from rotapanel.operators.design import MarginCalibration, SurveyDesign
from rotapanel.operators.estimation import degrees_of_freedom, rollup_totals, sum_over_months, survey_ratio, survey_total, with_national
from rotapanel.operators.longitudinal import linked
from rotapanel.operators.overlap import overlap_share
from rotapanel.operators.replication import (
    bootstrap_totals, calibrated_jackknife, full_totals, half_sample_totals, jackknife_totals, replicate_variance, unit_vectors,
)
from rotapanel.operators.statset import domain_means, joint_proportions, level_measures, reduced, stat_set
from rotapanel.plans import annual as annual_plan
from rotapanel.plans import panel as panel_plan
from rotapanel.plans import quarterly as quarterly_plan
from rotapanel.sources.microdata import QUARTERS

T1 = ", t1 AS (SELECT * FROM cali WHERE trimestre = 'T1')"
T12 = ", t12 AS (SELECT * FROM cali WHERE trimestre IN ('T1', 'T2'))"
T123 = ", t123 AS (SELECT * FROM cali WHERE trimestre IN ('T1', 'T2', 'T3'))"


def _design(spark, sf, quarters):
    return quarterly_plan.quarterly_design(base(spark, sf), controls(spark, sf), quarters)


def _annual(spark, sf):
    return annual_plan.annual_design(base(spark, sf), controls(spark, sf))


def _quarters(names):
    return {q: F.col("trimestre") == q for q in names}


@query("j1_monthly_totals_variance", sql(
    """
SELECT mes_trimestre, round(t, 2) AS total, round(v, 0) AS var
FROM (SELECT mes_trimestre, sum(dk_mes_cali) AS t FROM t1 GROUP BY 1) JOIN ve USING (mes_trimestre)""",
    QUARTERLY_CAL, T1, variance("t1", ["mes_trimestre"], "dk_mes_cali", name="ve"),
))
def monthly_totals(spark, sf):
    out = survey_total(_design(spark, sf, ["T1"]), ["mes_trimestre"])
    return rounded(out.select("mes_trimestre", "total", "var"), total=2, var=0)


@query("j2_totals_with_error", sql(
    """
SELECT estrato, round(t, 2) AS total, round(sqrt(v), 3) AS se
FROM (SELECT estrato, sum(dk_anual_calib * y) AS t FROM cali2 GROUP BY 1) JOIN ve USING (estrato)""",
    ANNUAL_CAL,
    """, ve AS (
  SELECT estrato, count(*) / (count(*) - 1.0::DOUBLE) * (sum(z * z) - sum(z) * sum(z) / count(*)) AS v
  FROM (SELECT estrato, upm, sum(dk_anual_calib * y) AS z FROM cali2 GROUP BY 1, 2) GROUP BY 1)""",
))
def totals_with_error(spark, sf):
    out = survey_total(_annual(spark, sf), ["estrato"], F.col("y"))
    return rounded(out.select("estrato", "total", "se"), total=2, se=3)


@query("j3_two_way_totals", sql(
    """
SELECT mes_trimestre, trabajo, round(t, 2) AS total, round(sqrt(v), 3) AS se
FROM (SELECT mes_trimestre, trabajo, sum(dk_mes_cali) AS t FROM t1 WHERE trabajo IS NOT NULL GROUP BY 1, 2)
JOIN ve USING (mes_trimestre, trabajo)""",
    QUARTERLY_CAL, T1, variance("t1", ["mes_trimestre", "trabajo"], "dk_mes_cali", "trabajo IS NOT NULL", "ve"),
))
def two_way_totals(spark, sf):
    design = _design(spark, sf, ["T1"]).where(F.col("trabajo").isNotNull())
    out = survey_total(design, ["mes_trimestre", "trabajo"])
    return rounded(out.select("mes_trimestre", "trabajo", "total", "se"), total=2, se=3)


@query("j4_quarterly_total_of_months", sql(
    """
SELECT round(sum(t), 2) AS total_trim, round(sqrt(sum(v)), 3) AS se_trim
FROM (SELECT mes_trimestre, sum(dk_mes_cali) AS t FROM t1 GROUP BY 1) JOIN ve USING (mes_trimestre)""",
    QUARTERLY_CAL, T1, variance("t1", ["mes_trimestre"], "dk_mes_cali", name="ve"),
))
def quarterly_total(spark, sf):
    out = sum_over_months(survey_total(_design(spark, sf, ["T1"]), ["mes_trimestre"]))
    return rounded(out, total_trim=2, se_trim=3)


CELLS = ", celdas AS (SELECT estrato, upm, trim_mes || '.' || y AS stat, sum(dk_anual_calib) AS z FROM cali2 GROUP BY 1, 2, 3)"


def _by_cell(spark, sf):
    return reduced(_annual(spark, sf), ["trim_mes", "y"])


def _cells(spark, sf):
    return stat_set(_by_cell(spark, sf), level_measures(annual_plan.month_by_outcome()))


@query("j5_crossed_totals_covariance", sql(
    "SELECT stat_a, stat_b, round(cov, 0) + 0 AS cov FROM vc", ANNUAL_CAL, CELLS, covariance("cali2", "celdas")
))
def crossed_covariance(spark, sf):
    return _cells(spark, sf).vcov().withColumn("cov", F.round("cov", 0) + 0)


@query("j5_crossed_totals", sql(
    """
SELECT c.stat, round(sum(c.z), 2) AS estimate, round(sqrt(any_value(v.cov)), 3) AS se
FROM celdas c JOIN vc v ON v.stat_a = c.stat AND v.stat_b = c.stat GROUP BY 1""",
    ANNUAL_CAL, CELLS, covariance("cali2", "celdas"),
))
def crossed_totals(spark, sf):
    return rounded(_cells(spark, sf).estimates(), estimate=2, se=3)


@query("j6_annual_variance_blocks", sql(
    """
SELECT round((SELECT sum(z) FROM celdas WHERE stat LIKE '%.1'), 2) AS total, round(sum(cov), 0) AS var_total,
       round(sum(cov) FILTER (stat_a = stat_b), 0) AS var_diag, round(sum(cov) FILTER (stat_a <> stat_b), 0) AS var_cov,
       round(sqrt(sum(cov)), 3) AS se
FROM vc WHERE stat_a LIKE '%.1' AND stat_b LIKE '%.1'""",
    ANNUAL_CAL, CELLS, covariance("cali2", "celdas"),
))
def variance_blocks(spark, sf):
    unemployed_cells = {n: c for n, c in annual_plan.month_by_outcome().items() if n.endswith(".1")}
    stats = stat_set(_by_cell(spark, sf), level_measures(unemployed_cells))
    out = stats.block(stats.names)
    return rounded(out, total=2, var_total=0, var_diag=0, var_cov=0, se=3)


@query("j7_overall_total", sql(
    """
SELECT round((SELECT sum(dk_anual_calib * y) FROM cali2), 2) AS total, round(sqrt(v), 3) AS se FROM ve""",
    ANNUAL_CAL, variance("cali2", [], "dk_anual_calib * y", name="ve"),
))
def overall_total(spark, sf):
    out = survey_total(_annual(spark, sf), y=F.col("y"))
    return rounded(out.select("total", "se"), total=2, se=3)


PROPORTIONS = """, grande AS (SELECT sum(dk_anual_calib) AS n FROM cali2),
pc AS (SELECT stat, sum(z) / any_value(n) AS p FROM celdas, grande GROUP BY 1),
todo AS (SELECT estrato, upm, sum(z) AS s FROM celdas GROUP BY 1, 2),
zp AS (
  SELECT t.estrato, t.upm, pc.stat, (coalesce(c.z, 0) - p * s) / n AS z
  FROM todo t CROSS JOIN pc CROSS JOIN grande
  LEFT JOIN celdas c ON c.estrato = t.estrato AND c.upm = t.upm AND c.stat = pc.stat)
"""


def _proportions(spark, sf):
    return joint_proportions(_by_cell(spark, sf), annual_plan.month_by_outcome())


@query("j8_joint_proportions", sql(
    """
SELECT stat, round(p, 9) AS estimate, round(sqrt(cov), 9) AS se FROM pc JOIN vc ON stat_a = stat AND stat_b = stat""",
    ANNUAL_CAL, CELLS, PROPORTIONS, covariance("cali2", "zp"),
))
def proportions(spark, sf):
    return rounded(_proportions(spark, sf).estimates(), estimate=9, se=9)


@query("j9_net_change_of_proportions", sql(
    """
, x AS (SELECT max(p) FILTER (stat = 'T1_M1.1') - max(p) FILTER (stat = 'T1_M2.1') AS delta FROM pc),
y AS (SELECT max(cov) FILTER (stat_a = 'T1_M1.1' AND stat_b = 'T1_M1.1') AS v2,
             max(cov) FILTER (stat_a = 'T1_M2.1' AND stat_b = 'T1_M2.1') AS v1,
             max(cov) FILTER (stat_a = 'T1_M1.1' AND stat_b = 'T1_M2.1') AS c12 FROM vc)
SELECT round(delta, 9) AS delta, round(v1, 12) AS var_1, round(v2, 12) AS var_2, round(c12, 12) AS cov_12,
       round(sqrt(v1 + v2 - 2 * c12), 9) AS se FROM x, y""",
    ANNUAL_CAL, CELLS, PROPORTIONS, covariance("cali2", "zp"),
))
def change_of_proportions(spark, sf):
    cells = annual_plan.month_by_outcome()
    two = {n: cells[n] for n in ("T1_M1.1", "T1_M2.1")}
    out = net_change(joint_proportions(_by_cell(spark, sf), two), "T1_M1.1", "T1_M2.1")
    return rounded(out, delta=9, var_1=12, var_2=12, cov_12=12, se=9)


def _means_sql(src: str) -> str:
    return f""", med AS (
  SELECT trimestre, sum(dk_mes_cali * ingreso) / sum(dk_mes_cali) AS m, sum(dk_mes_cali) AS n FROM {src} GROUP BY 1),
zm AS (
  SELECT estrato, upm, s.trimestre AS stat, sum(dk_mes_cali * (ingreso - m)) / any_value(n) AS z
  FROM {src} s JOIN med USING (trimestre) GROUP BY 1, 2, 3)
""" + covariance(src, "zm")


@query("j10_means_with_error", sql(
    """
SELECT trimestre AS stat, round(m, 6) AS estimate, round(sqrt(cov), 6) AS se
FROM med JOIN vc ON stat_a = trimestre AND stat_b = trimestre""",
    QUARTERLY_CAL, T12, _means_sql("t12"),
))
def means(spark, sf):
    out = domain_means(_design(spark, sf, ["T1", "T2"]), F.col("ingreso"), _quarters(["T1", "T2"]))
    return rounded(out.estimates(), estimate=6, se=6)


@query("j11_covariance_of_means", sql(
    "SELECT stat_a, stat_b, round(cov, 3) AS cov FROM vc", QUARTERLY_CAL, T123, _means_sql("t123")
))
def covariance_of_means(spark, sf):
    out = domain_means(_design(spark, sf, ["T1", "T2", "T3"]), F.col("ingreso"), _quarters(["T1", "T2", "T3"]))
    return rounded(out.vcov(), cov=3)


@query("j12_contrast_of_quarters", sql(
    """
SELECT 'T2 - T1' AS stat,
       round((SELECT m FROM med WHERE trimestre = 'T2') - (SELECT m FROM med WHERE trimestre = 'T1'), 5) AS estimate,
       round(sqrt(sum(CASE WHEN stat_a = stat_b THEN cov ELSE -cov END)), 5) AS se FROM vc""",
    QUARTERLY_CAL, T12, _means_sql("t12"),
))
def contrast_of_quarters(spark, sf):
    stats = domain_means(_design(spark, sf, ["T1", "T2"]), F.col("ingreso"), _quarters(["T1", "T2"]))
    return rounded(contrast(stats, {"T2": 1, "T1": -1}, "T2 - T1"), estimate=5, se=5)


@query("j13_mean_of_three_quarters", sql(
    """
SELECT '(T1 + T2 + T3) / 3' AS stat, round((SELECT avg(m) FROM med), 5) AS estimate, round(sqrt(sum(cov)) / 3, 5) AS se FROM vc""",
    QUARTERLY_CAL, T123, _means_sql("t123"),
))
def mean_of_three(spark, sf):
    names = ["T1", "T2", "T3"]
    stats = domain_means(_design(spark, sf, names), F.col("ingreso"), _quarters(names))
    out = contrast(stats, dict.fromkeys(names, 1 / 3), "(T1 + T2 + T3) / 3")
    return rounded(out, estimate=5, se=5)


RATES = """, tasa AS (
  SELECT trimestre, sum(dk_mes_cali * yk) / sum(dk_mes_cali * zk) AS m, sum(dk_mes_cali * zk) AS n FROM pea GROUP BY 1),
zm AS (
  SELECT estrato, upm, s.trimestre AS stat, sum(dk_mes_cali * (yk - m * zk)) / any_value(n) AS z
  FROM pea s JOIN tasa USING (trimestre) GROUP BY 1, 2, 3)
"""
PEA = """, pea AS (
  SELECT *, CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END AS yk,
         CASE WHEN trabajo IN ('Ocupado', 'Desocupado') THEN 1 ELSE 0 END AS zk
  FROM cali WHERE trimestre IN ('T1', 'T2'))
"""


@query("j14_net_change_of_ratio", sql(
    """
SELECT round((SELECT m FROM tasa WHERE trimestre = 'T2') - (SELECT m FROM tasa WHERE trimestre = 'T1'), 8) AS delta,
       round(max(cov) FILTER (stat_a = 'T1' AND stat_b = 'T1'), 10) AS var_1,
       round(max(cov) FILTER (stat_a = 'T2' AND stat_b = 'T2'), 10) AS var_2,
       round(max(cov) FILTER (stat_a = 'T1' AND stat_b = 'T2'), 10) AS cov_12,
       round(sqrt(sum(CASE WHEN stat_a = stat_b THEN cov ELSE -cov END)), 8) AS se FROM vc""",
    QUARTERLY_CAL, PEA, RATES, covariance("pea", "zm"),
))
def change_of_ratio(spark, sf):
    y, z = unemployed(), in_labour_force()
    totals = stat_set(_design(spark, sf, ["T1", "T2"]), level_measures(_quarters(["T1", "T2"]), {"y": y, "z": z}))
    rates = totals.ratios({q: (f"{q}|y", f"{q}|z") for q in ("T1", "T2")})
    return rounded(net_change(rates, "T2", "T1"), delta=8, var_1=10, var_2=10, cov_12=10, se=8)


@query("j2_ratio_with_error", sql(
    """
SELECT trimestre, round(m, 8) AS ratio, round(sqrt(cov), 8) AS se FROM tasa JOIN vc ON stat_a = trimestre AND stat_b = trimestre""",
    QUARTERLY_CAL, PEA, RATES, covariance("pea", "zm"),
))
def ratio_with_error(spark, sf):
    out = survey_ratio(
        _design(spark, sf, ["T1", "T2"]),
        F.coalesce(unemployed(), F.lit(0)), F.coalesce(in_labour_force(), F.lit(0)), ["trimestre"],
    )
    return rounded(out.select("trimestre", "ratio", "se"), ratio=8, se=8)


# Planning inputs: two quarterly variances, the overlap of households and the income correlation.
PLANNING = """
, enlace AS (
  SELECT a.fep AS w, a.ingreso AS x, b.ingreso AS y FROM base a JOIN base b
    ON a.id_hogar = b.id_hogar AND a.id_pers = b.id_pers AND a.trimestre = 'T1' AND b.trimestre = 'T2'),
medias AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM enlace),
corr12 AS (
  SELECT count(*) AS n, sum(w * (x - mx) * (y - my)) / (sqrt(sum(w * (x - mx) * (x - mx))) * sqrt(sum(w * (y - my) * (y - my)))) AS r12
  FROM enlace, medias),
tras AS (
  SELECT (SELECT count(*) FROM (SELECT id_hogar FROM base WHERE trimestre = 'T1' INTERSECT
                                SELECT id_hogar FROM base WHERE trimestre = 'T2'))
         / (SELECT count(DISTINCT id_hogar) FROM base WHERE trimestre = 'T1') AS t),
vm AS (SELECT max(cov) FILTER (stat_a = 'T1' AND stat_b = 'T1') AS v1, max(cov) FILTER (stat_a = 'T2' AND stat_b = 'T2') AS v2 FROM vc)
"""


def _planning(spark, sf):
    """One row: v1, v2, t, r12 of income between the first two quarters."""
    stats = domain_means(_design(spark, sf, ["T1", "T2"]), F.col("ingreso"), _quarters(["T1", "T2"]))
    variances = stats.row.select(stats.cov("T1", "T1").alias("v1"), stats.cov("T2", "T2").alias("v2"))
    people = base(spark, sf, ["T1", "T2"])
    share = overlap_share(people, ["id_hogar"]).select("t")
    pairs = linked(people, "T1", "T2", {"w": "fep", "x": "ingreso"}, {"y": "ingreso"})
    r = weighted_correlation(pairs, "x", "y", "w").select("r12")
    return variances.join(share, F.lit(True)).join(r, F.lit(True))


def _planning_sql(body: str) -> str:
    return sql(body, QUARTERLY_CAL, T12, _means_sql("t12"), PLANNING)


@query("j15_planning_variance_of_change", _planning_sql("""
SELECT round(v1 + v2 - 2 * sqrt(v1) * sqrt(v2) * t * r12, 3) AS rotativa, round(v1 + v2, 3) AS repetida,
       round(v1 + v2 - 2 * sqrt(v1) * sqrt(v2) * r12, 3) AS panel, round(2 * v1 * (1 - t * r12), 3) AS iguales
FROM vm, tras, corr12"""))
def planning_change(spark, sf):
    v1, v2, t, r = (F.col(c) for c in ("v1", "v2", "t", "r12"))
    zero, one = F.lit(0.0), F.lit(1.0)
    out = _planning(spark, sf).select(
        change_variance(v1, v2, t, t, r).alias("rotativa"),
        change_variance(v1, v2, zero, zero, r).alias("repetida"),
        change_variance(v1, v2, one, one, r).alias("panel"),
        change_variance(v1, v1, t, t, r).alias("iguales"),
    )
    return rounded(out, rotativa=3, repetida=3, panel=3, iguales=3)


@query("j16_planning_variance_of_mean", _planning_sql("""
SELECT round(v1 / 9 * (3 + 6 * t * r12), 3) AS rotativa, round(v1 / 3, 3) AS repetida, round(v1 / 9 * (3 + 6 * r12), 3) AS panel
FROM vm, tras, corr12"""))
def planning_mean(spark, sf):
    v, t, r = F.col("v1"), F.col("t"), F.col("r12")
    out = _planning(spark, sf).select(
        mean_of_three_variance(v, t, r).alias("rotativa"),
        mean_of_three_variance(v, F.lit(0.0), r).alias("repetida"),
        mean_of_three_variance(v, F.lit(1.0), r).alias("panel"),
    )
    return rounded(out, rotativa=3, repetida=3, panel=3)


@query("j17_overlap_and_correlation", _planning_sql("SELECT round(t, 9) AS t, round(r12, 9) AS r12 FROM tras, corr12"))
def overlap_and_correlation(spark, sf):
    return rounded(_planning(spark, sf).select("t", "r12"), t=9, r12=9)


DF_SQL = """, gl AS (SELECT count(DISTINCT (estrato, upm)) - count(DISTINCT estrato) AS df FROM t12)"""


@query("j18_design_t_test", sql(
    """
, d AS (SELECT (SELECT m FROM med WHERE trimestre = 'T2') - (SELECT m FROM med WHERE trimestre = 'T1') AS delta,
               sqrt(sum(CASE WHEN stat_a = stat_b THEN cov ELSE -cov END)) AS se FROM vc)
SELECT round(delta, 5) AS delta, round(se, 5) AS se, df, round(delta / se, 7) AS t, round(t_crit, 6) AS t_crit,
       round(1 - """ + t_within("(delta / se)", "df") + """, 6) AS p, abs(delta / se) > t_crit AS reject
FROM d, uno JOIN puntos USING (df)""",
    QUARTERLY_CAL, T12, _means_sql("t12"), DF_SQL, ", uno AS (SELECT df - 1 AS df FROM gl)", t_points("uno"),
))
def t_test(spark, sf):
    out = design_t_test(_design(spark, sf, ["T1", "T2"]), F.col("ingreso"), _quarters(["T1", "T2"]))
    return rounded(out, delta=5, se=5, t=7, t_crit=6, p=6)


@query("j19_t_statistic", sql(
    """
SELECT round(((SELECT m FROM tasa WHERE trimestre = 'T2') - (SELECT m FROM tasa WHERE trimestre = 'T1'))
       / sqrt(sum(CASE WHEN stat_a = stat_b THEN cov ELSE -cov END)), 6) AS t FROM vc""",
    QUARTERLY_CAL, PEA, RATES, covariance("pea", "zm"),
))
def t_statistic(spark, sf):
    totals = stat_set(
        _design(spark, sf, ["T1", "T2"]), level_measures(_quarters(["T1", "T2"]), {"y": unemployed(), "z": in_labour_force()})
    )
    change = net_change(totals.ratios({q: (f"{q}|y", f"{q}|z") for q in ("T1", "T2")}), "T2", "T1")
    return change.select(F.round(F.col("delta") / F.col("se"), 6).alias("t"))


@query("j20_degrees_of_freedom", sql("""
SELECT count(DISTINCT upm) AS n_psu, count(DISTINCT estrato) AS n_strata, count(DISTINCT upm) - count(DISTINCT estrato) AS df
FROM base"""))
def df_of_design(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep")
    return degrees_of_freedom(design).select("n_psu", "n_strata", "df")


@query("j21_degrees_of_freedom_domain", sql("""
SELECT CAST(sum(n - 1) AS BIGINT) AS df_domain FROM (SELECT estrato, count(DISTINCT upm) AS n FROM base GROUP BY 1)
WHERE estrato IN (SELECT estrato FROM base WHERE dam IN ('0', '3') AND sexo = 'Mujer')"""))
def df_of_domain(spark, sf):
    design = SurveyDesign(base(spark, sf), "fep").where(F.col("dam").isin("0", "3") & (F.col("sexo") == "Mujer"))
    return degrees_of_freedom(design).select("df_domain")


@query("j22_critical_values", sql(
    "SELECT estrato, df, round(t_crit, 6) AS t_crit FROM gl JOIN puntos USING (df)",
    ", gl AS (SELECT estrato, count(DISTINCT upm) - 1 AS df FROM base GROUP BY 1)",
    t_points("gl"),
))
def critical_values(spark, sf):
    sizes = SurveyDesign(base(spark, sf), "fep").strata_sizes()
    return sizes.select("estrato", (F.col("n_psu") - 1).alias("df")).withColumn("t_crit", F.round(t_point("df"), 6))


@query("j23_covariance_scenarios", _planning_sql("""
SELECT escenario, round(sqrt(v1) * sqrt(v2) * sqrt(a) * sqrt(b) * r, 3) AS cov FROM (
  SELECT 'independientes' AS escenario, v1, v2, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, r12 AS r FROM vm, corr12
  UNION ALL SELECT 'rotativo 2(2)2', v1, v2, 0.5, 0.5, r12 FROM vm, corr12
  UNION ALL SELECT 'subgrupos dependientes', v1, v2, t, 1.0, r12 FROM vm, corr12, tras
  UNION ALL SELECT 'subgrupos independientes', v1, v2, t, 1.0, 0.0 FROM vm, tras)"""))
def covariance_scenarios(spark, sf):
    t, r = F.col("t"), F.col("r12")
    zero, half, one = F.lit(0.0), F.lit(0.5), F.lit(1.0)
    cases = {
        "independientes": (zero, zero, r),
        "rotativo 2(2)2": (half, half, r),
        "subgrupos dependientes": (t, one, r),
        "subgrupos independientes": (t, one, zero),
    }
    rows = [
        F.struct(F.lit(n).alias("escenario"), F.round(covariance_between(F.col("v1"), F.col("v2"), a, b, c), 3).alias("cov"))
        for n, (a, b, c) in cases.items()
    ]
    return _planning(spark, sf).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


@query("j24_lonely_unit_certainty", sql(
    """
SELECT trimestre, round(t, 2) AS total, round(sqrt(v), 4) AS se
FROM (SELECT trimestre, sum(fep) AS t FROM sola GROUP BY 1) JOIN ve USING (trimestre)""",
    ", sola AS (SELECT * FROM base WHERE dam <> '1' OR upm = (SELECT min(upm) FROM base WHERE dam = '1'))",
    variance("sola", ["trimestre"], "fep", name="ve", lonely="0"),
))
def lonely_unit(spark, sf):
    people = base(spark, sf)
    first = people.where(F.col("dam") == "1").agg(F.min("upm").alias("u")).first().u
    design = SurveyDesign(people, "fep", lonely_psu="certainty").subset((F.col("dam") != "1") | (F.col("upm") == first))
    return rounded(survey_total(design, ["trimestre"]).select("trimestre", "total", "se"), total=2, se=4)


RESIDUAL = """, hres AS (
  SELECT f.*, CASE WHEN sexo = 'Mujer' THEN 1 ELSE 0 END
         - sum(fep_aj * CASE WHEN sexo = 'Mujer' THEN 1 ELSE 0 END) OVER (PARTITION BY estrato)
           / sum(fep_aj) OVER (PARTITION BY estrato) AS e FROM final f)
"""


@query("j25_residual_variance_strata", sql(
    """
SELECT round((SELECT sum(fex_cali) FROM final WHERE sexo = 'Mujer'), 2) AS total, round(sqrt(v), 3) AS se FROM ve""",
    PANEL_FINAL, RESIDUAL, variance("hres", [], "fex_cali * e", name="ve"),
))
def residual_variance_strata(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    design = panel_plan.panel_design(final, residual=True).where(F.col("sexo") == "Mujer")
    return rounded(survey_total(design).select("total", "se"), total=2, se=3)


@query("j25_residual_variance_households", sql(
    """
, ph AS (SELECT *, n_personas - sum(dk_anual * n_personas * n_personas) OVER (PARTITION BY estrato)
            / sum(dk_anual * n_personas * n_personas) OVER (PARTITION BY estrato) * n_personas AS e0,
            CASE WHEN trimestre = 'T1' THEN n_personas ELSE 0 END
            - sum(CASE WHEN trimestre = 'T1' THEN dk_anual * n_personas * n_personas ELSE 0 END) OVER (PARTITION BY estrato)
            / sum(dk_anual * n_personas * n_personas) OVER (PARTITION BY estrato) * n_personas AS e FROM hogcal2)
, ve1_n AS (SELECT estrato, count(*) AS n FROM (SELECT DISTINCT estrato, upm FROM ph) GROUP BY 1)
, ve1 AS (SELECT sum(v) AS v FROM (
    SELECT estrato, any_value(n) / (any_value(n) - 1.0::DOUBLE) * (sum(z * z) - sum(z) * sum(z) / any_value(n)) AS v
    FROM (SELECT estrato, upm, sum(dk_anual_calib * e) AS z FROM ph GROUP BY 1, 2) JOIN ve1_n USING (estrato) GROUP BY 1))
SELECT round((SELECT sum(dk_anual_calib * n_personas) FROM hogcal2 WHERE trimestre = 'T1'), 2) AS total, round(sqrt(v), 3) AS se FROM ve1""",
    ANNUAL_CAL,
))
def residual_variance_households(spark, sf):
    design = annual_plan.calibrated_household_design(base(spark, sf), controls(spark, sf))
    out = survey_total(design.where(F.col("trimestre") == "T1"), y=F.col("n_personas"))
    return rounded(out.select("total", "se"), total=2, se=3)


@query("j25_residual_variance_margins", sql(
    """
, bet AS (
  SELECT sum(d * y) FILTER (area = '1') AS r1, sum(d * y) FILTER (area = '2') AS r2, sum(d * y) FILTER (sexo = 'Mujer') AS r3
  FROM yy),
beta AS (
  SELECT (r1 * (b * c - bc * bc) - ac * (b * r3 - r2 * bc)) / det AS l1,
         (a * (r2 * c - bc * r3) - ac * ac * r2 + ac * bc * r1) / det AS l2,
         (a * (b * r3 - bc * r2) - ac * b * r1) / det AS l3 FROM bet, brecha),
res AS (
  SELECT yy.*, y - (CASE WHEN area = '1' THEN l1 ELSE l2 END) - (CASE WHEN sexo = 'Mujer' THEN l3 ELSE 0 END) AS e FROM yy, beta),
un AS (SELECT estrato, count(DISTINCT upm) AS n FROM res GROUP BY 1)
SELECT 'pobres' AS stat, round((SELECT sum(w * y) FROM yy), 2) AS estimate, round(sqrt(sum(v)), 3) AS se FROM (
  SELECT estrato, any_value(n) / (any_value(n) - 1.0::DOUBLE) * (sum(z * z) - sum(z) * sum(z) / any_value(n)) AS v
  FROM (SELECT estrato, upm, sum(w * e) AS z FROM res GROUP BY 1, 2) JOIN un USING (estrato) GROUP BY 1)""",
    PANEL_FINAL,
    ", src AS (SELECT *, fep_aj AS d FROM final)",
    MARGINS_SQL,
    ", yy AS (SELECT *, CASE WHEN pobreza_t1 = 1 THEN 1 ELSE 0 END AS y FROM margen)",
))
def residual_variance_margins(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    people = calibrate(final, "fep_aj", margin_terms(), margin_totals(spark, sf))
    design = SurveyDesign(people, "w_cal", nest=False, calibration=MarginCalibration("fep_aj", margin_terms()))
    out = stat_set(design, {"pobres": F.when(F.col("pobreza_t1") == 1, 1.0)}).estimates()
    return rounded(out, estimate=2, se=3)


def _margin_domain_sql(domain: str, label: str) -> str:
    """Total and residual error of one domain of the margin-calibrated panel."""
    return f"""SELECT {label} AS dominio, round((SELECT sum(w) FROM margen WHERE {domain}), 2) AS total, round(sqrt(greatest(sum(v), 0)), 2) + 0.0 AS se
FROM (SELECT estrato, any_value(n) / (any_value(n) - 1.0::DOUBLE) * (sum(z * z) - sum(z) * sum(z) / any_value(n)) AS v
  FROM (SELECT estrato, upm, sum(w * (y - (CASE WHEN area = '1' THEN l1 ELSE l2 END) - (CASE WHEN sexo = 'Mujer' THEN l3 ELSE 0 END))) AS z
    FROM (SELECT *, CASE WHEN {domain} THEN 1 ELSE 0 END AS y FROM margen),
      (SELECT (r1 * (b * c - bc * bc) - ac * (b * r3 - r2 * bc)) / det AS l1,
              (a * (r2 * c - bc * r3) - ac * ac * r2 + ac * bc * r1) / det AS l2,
              (a * (b * r3 - bc * r2) - ac * b * r1) / det AS l3
       FROM brecha, (SELECT coalesce(sum(d) FILTER (area = '1'), 0) AS r1, coalesce(sum(d) FILTER (area = '2'), 0) AS r2,
                            coalesce(sum(d) FILTER (sexo = 'Mujer'), 0) AS r3 FROM margen WHERE {domain})) GROUP BY 1, 2)
  JOIN (SELECT estrato, count(DISTINCT upm) AS n FROM margen GROUP BY 1) USING (estrato) GROUP BY 1)"""


def _margin_design(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    people = calibrate(final, "fep_aj", margin_terms(), margin_totals(spark, sf))
    return SurveyDesign(people, "w_cal", nest=False, calibration=MarginCalibration("fep_aj", margin_terms()))


@query("j25_margin_totals_by_poverty", sql(
    " UNION ALL ".join(_margin_domain_sql(f"pobreza_t1 = {k}", f"'{k}'") for k in (1, 2, 3)),
    PANEL_FINAL, ", src AS (SELECT *, fep_aj AS d FROM final)", MARGINS_SQL,
))
def margin_totals_by_poverty(spark, sf):
    known = _margin_design(spark, sf).where(F.col("pobreza_t1").isNotNull())
    out = survey_total(known, ["pobreza_t1"]).select(F.col("pobreza_t1").cast("string").alias("dominio"), "total", "se")
    return rounded(out, total=2, se=2)


@query("j25_margin_rollup_by_area", sql(
    " UNION ALL ".join(_margin_domain_sql(c, label) for c, label in (("area = '1'", "'1'"), ("area = '2'", "'2'"), ("TRUE", "'Nacional'"))),
    PANEL_FINAL, ", src AS (SELECT *, fep_aj AS d FROM final)", MARGINS_SQL,
))
def margin_rollup_by_area(spark, sf):
    out = with_national(_margin_design(spark, sf), "area").select(F.col("area").alias("dominio"), "total", "se")
    return rounded(out, total=2, se=2)


@query("j25_margin_rollup_by_sex", sql(
    " UNION ALL ".join(
        _margin_domain_sql(c, label) for c, label in (("sexo = 'Hombre'", "'Hombre'"), ("sexo = 'Mujer'", "'Mujer'"), ("TRUE", "'Nacional'"))
    ),
    PANEL_FINAL, ", src AS (SELECT *, fep_aj AS d FROM final)", MARGINS_SQL,
))
def margin_rollup_by_sex(spark, sf):
    out = with_national(_margin_design(spark, sf), "sexo").select(F.col("sexo").alias("dominio"), "total", "se")
    return rounded(out, total=2, se=2)


_AREAS, _SEXES = [("area = '1'", "1"), ("area = '2'", "2"), ("TRUE", "Nacional")], [("sexo = 'Hombre'", "Hombre"), ("sexo = 'Mujer'", "Mujer"), ("TRUE", "Nacional")]


@query("d12_rollup_of_two_factors", sql(
    " UNION ALL ".join(_margin_domain_sql(f"{a} AND {s}", f"'{x}|{y}'") for a, x in _AREAS for s, y in _SEXES if (x, y) != ("Nacional", "Hombre") and (x, y) != ("Nacional", "Mujer")),
    PANEL_FINAL, ", src AS (SELECT *, fep_aj AS d FROM final)", MARGINS_SQL,
))
def rollup_of_two_factors(spark, sf):
    out = rollup_totals(_margin_design(spark, sf), ["area", "sexo"])
    return rounded(out.select(F.concat_ws("|", "area", "sexo").alias("dominio"), "total", "se"), total=2, se=2)


@query("e4_moving_quarter_with_error", sql("""
, zmes AS (
  SELECT estrato, upm, (substr(trimestre, 2, 1)::INTEGER - 1) * 3 + substr(mes_trimestre, 2, 1)::INTEGER AS mes,
         sum(fep * CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END) AS y, sum(fep * CASE WHEN trabajo <> 'Inactivo' THEN 1 ELSE 0 END) AS z
  FROM base GROUP BY 1, 2, 3),
ventana AS (SELECT e AS mes_fin, sum(y) AS y, sum(z) AS z FROM range(3, 13) r(e) JOIN zmes ON mes BETWEEN e - 2 AND e GROUP BY 1),
uni AS (SELECT estrato, upm, count(*) OVER (PARTITION BY estrato) AS n FROM (SELECT DISTINCT estrato, upm FROM base)),
lin AS (
  SELECT u.estrato, u.upm, any_value(n) AS n, v.mes_fin, coalesce(sum(m.y - v.y / v.z * m.z), 0) / any_value(v.z) AS x
  FROM uni u CROSS JOIN ventana v LEFT JOIN zmes m ON m.estrato = u.estrato AND m.upm = u.upm AND m.mes BETWEEN v.mes_fin - 2 AND v.mes_fin
  GROUP BY u.estrato, u.upm, v.mes_fin),
vh AS (
  SELECT mes_fin, any_value(n) / (any_value(n) - 1.0::DOUBLE) * (sum(x * x) - sum(x) * sum(x) / any_value(n)) AS v FROM lin GROUP BY estrato, mes_fin)
SELECT CAST(mes_fin AS VARCHAR) AS mes_fin, round(any_value(y) / any_value(z), 8) AS theta, round(sqrt(sum(v)), 8) AS se
FROM vh JOIN ventana USING (mes_fin) GROUP BY 1"""))
def moving_quarter_with_error(spark, sf):
    month = (F.substring("trimestre", 2, 1).cast("int") - 1) * 3 + F.substring("mes_trimestre", 2, 1).cast("int")
    people = base(spark, sf).withColumn("mes", month)
    design = SurveyDesign(people, "fep")
    months = {str(m): F.col("mes") == m for m in range(1, 13)}
    out = moving_rates(design, months, unemployed(), in_labour_force()).estimates()
    return rounded(out.select(F.col("stat").alias("mes_fin"), F.col("estimate").alias("theta"), "se"), theta=8, se=8)


@query("j26_plain_weights_variance", sql(
    """
SELECT round((SELECT sum(fex_cali) FROM final WHERE sexo = 'Mujer'), 2) AS total, round(sqrt(v), 3) AS se FROM ve""",
    PANEL_FINAL, variance("final", [], "fex_cali", "sexo = 'Mujer'", "ve"),
))
def plain_variance(spark, sf):
    final = panel_plan.final_base(panel_plan.scored_panel(base(spark, sf), 0.75), controls(spark, sf), "pobreza")
    design = panel_plan.panel_design(final, residual=True).plain().where(F.col("sexo") == "Mujer")
    return rounded(survey_total(design).select("total", "se"), total=2, se=3)


def _rate_measures():
    out = {}
    for q in QUARTERS:
        here = F.col("trimestre") == q
        out[f"{q}|y"] = F.when(here, unemployed())
        out[f"{q}|z"] = F.when(here, in_labour_force())
    return out


def _rates_of(index: int):
    return lambda cells: cells[2 * index] / cells[2 * index + 1]


def _replicated(spark, sf, how: str):
    design = SurveyDesign(base(spark, sf), "fep")
    measures = _rate_measures()
    units = unit_vectors(design, measures)
    size = len(measures)
    if how == "jackknife":
        replicates = jackknife_totals(design, units, size)
    elif how == "bootstrap":
        replicates = bootstrap_totals(units, size)
    else:
        replicates = half_sample_totals(units, size)
    return replicate_variance(replicates, full_totals(units, size), {q: _rates_of(i) for i, q in enumerate(QUARTERS)})


JACKKNIFE_SQL = """
, u AS (
  SELECT estrato, upm, trimestre, sum(fep * CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END) AS y,
         sum(fep * CASE WHEN trabajo IN ('Ocupado', 'Desocupado') THEN 1 ELSE 0 END) AS z FROM base GROUP BY 1, 2, 3),
unidades AS (SELECT DISTINCT estrato, upm FROM base),
tam_h AS (SELECT estrato, count(*) AS n FROM unidades GROUP BY 1),
rep AS (
  SELECT r.estrato, r.upm, u.trimestre,
         sum(u.y * CASE WHEN u.estrato <> r.estrato THEN 1.0::DOUBLE WHEN u.upm = r.upm THEN 0.0 ELSE n / (n - 1.0::DOUBLE) END) AS y,
         sum(u.z * CASE WHEN u.estrato <> r.estrato THEN 1.0::DOUBLE WHEN u.upm = r.upm THEN 0.0 ELSE n / (n - 1.0::DOUBLE) END) AS z,
         any_value(n) AS n
  FROM unidades r JOIN tam_h ON r.estrato = tam_h.estrato CROSS JOIN u GROUP BY 1, 2, 3),
full_r AS (SELECT trimestre, sum(y) / sum(z) AS theta FROM u GROUP BY 1)
SELECT trimestre AS stat, round(any_value(theta), 8) AS estimate,
       round(sum((n - 1.0::DOUBLE) / n * (y / z - theta) * (y / z - theta)), 10) AS var,
       round(sqrt(sum((n - 1.0::DOUBLE) / n * (y / z - theta) * (y / z - theta))), 8) AS se
FROM rep JOIN full_r USING (trimestre) GROUP BY 1"""


@query("j27_jackknife", sql(JACKKNIFE_SQL))
def jackknife(spark, sf):
    return rounded(_replicated(spark, sf, "jackknife"), estimate=8, var=10, se=8)


BOOTSTRAP_SQL = """
, u AS (
  SELECT estrato, upm, trimestre, sum(fep * CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END) AS y,
         sum(fep * CASE WHEN trabajo IN ('Ocupado', 'Desocupado') THEN 1 ELSE 0 END) AS z FROM base GROUP BY 1, 2, 3),
num AS (SELECT estrato, upm, row_number() OVER (PARTITION BY estrato ORDER BY upm) AS k FROM (SELECT DISTINCT estrato, upm FROM base)),
tam_h AS (SELECT estrato, count(*) AS n FROM num GROUP BY 1),
sorteo AS (
  SELECT estrato, n, r.rep, ('0x' || substr(md5(estrato || ':' || r.rep || ':' || d.draw || ':15'), 1, 8))::BIGINT % n + 1 AS k
  FROM tam_h, (SELECT unnest(range(1, 201)) AS rep) r, (SELECT unnest(range(1, 1000)) AS draw) d WHERE d.draw <= n - 1),
rep AS (
  SELECT s.rep, trimestre, sum(y * n / (n - 1.0::DOUBLE)) AS y, sum(z * n / (n - 1.0::DOUBLE)) AS z
  FROM sorteo s JOIN num ON s.estrato = num.estrato AND s.k = num.k JOIN u ON u.estrato = num.estrato AND u.upm = num.upm GROUP BY 1, 2),
full_r AS (SELECT trimestre, sum(y) / sum(z) AS theta FROM u GROUP BY 1)
SELECT trimestre AS stat, round(any_value(theta), 8) AS estimate, round(sum((y / z - theta) * (y / z - theta) / 200), 10) AS var,
       round(sqrt(sum((y / z - theta) * (y / z - theta) / 200)), 8) AS se
FROM rep JOIN full_r USING (trimestre) GROUP BY 1"""


@query("j27_bootstrap", sql(BOOTSTRAP_SQL))
def bootstrap(spark, sf):
    return rounded(_replicated(spark, sf, "bootstrap"), estimate=8, var=10, se=8)


HALF_SQL = """
, u AS (
  SELECT estrato, upm, trimestre, sum(fep * CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END) AS y,
         sum(fep * CASE WHEN trabajo IN ('Ocupado', 'Desocupado') THEN 1 ELSE 0 END) AS z FROM base GROUP BY 1, 2, 3),
num AS (
  SELECT estrato, upm, dense_rank() OVER (ORDER BY estrato) AS hn, row_number() OVER (PARTITION BY estrato ORDER BY upm) % 2 AS half
  FROM (SELECT DISTINCT estrato, upm FROM base)),
mitad AS (SELECT estrato, half, count(*) AS m FROM num GROUP BY 1, 2),
tam_h AS (SELECT estrato, sum(m) AS n FROM mitad GROUP BY 1),
esc AS (SELECT num.estrato, num.upm, hn, num.half, CAST(n AS DOUBLE) / m AS k
        FROM num JOIN mitad ON num.estrato = mitad.estrato AND num.half = mitad.half JOIN tam_h ON num.estrato = tam_h.estrato),
orden AS (SELECT CAST(pow(2, floor(log2(max(hn))) + 1) AS BIGINT) AS r FROM num),
reps AS (SELECT unnest(range(0, r)) AS rep, r FROM orden),
rep AS (
  SELECT rep, trimestre, sum(y * k) AS y, sum(z * k) AS z, any_value(r) AS r
  FROM reps JOIN esc ON bit_count(rep & hn) % 2 = half JOIN u ON u.estrato = esc.estrato AND u.upm = esc.upm GROUP BY 1, 2),
full_r AS (SELECT trimestre, sum(y) / sum(z) AS theta FROM u GROUP BY 1)
SELECT trimestre AS stat, round(any_value(theta), 8) AS estimate, round(sum((y / z - theta) * (y / z - theta) / r), 10) AS var,
       round(sqrt(sum((y / z - theta) * (y / z - theta) / r)), 8) AS se
FROM rep JOIN full_r USING (trimestre) GROUP BY 1"""


@query("j27_balanced_half_samples", sql(HALF_SQL))
def half_samples(spark, sf):
    return rounded(_replicated(spark, sf, "half"), estimate=8, var=10, se=8)


@query("j28_coefficient_of_variation", sql(
    """
SELECT mes_trimestre, round(sqrt(v) / t, 8) AS cv
FROM (SELECT mes_trimestre, sum(dk_mes_cali) AS t FROM t1 GROUP BY 1) JOIN ve USING (mes_trimestre)""",
    QUARTERLY_CAL, T1, variance("t1", ["mes_trimestre"], "dk_mes_cali", name="ve"),
))
def coefficient_of_variation(spark, sf):
    out = survey_total(_design(spark, sf, ["T1"]), ["mes_trimestre"])
    return out.select("mes_trimestre", F.round(cv("se", "total"), 8).alias("cv"))


CALIBRATED_JACKKNIFE_SQL = """, u AS (
  SELECT estrato, upm, sum(d) FILTER (area = '1') AS a, sum(d) FILTER (area = '2') AS b, sum(d) FILTER (sexo = 'Mujer') AS c,
         sum(d) FILTER (area = '1' AND sexo = 'Mujer') AS ac, sum(d) FILTER (area = '2' AND sexo = 'Mujer') AS bc,
         k FROM src, (VALUES (1), (2), (3)) q(k) GROUP BY estrato, upm, k),
cel AS (
  SELECT estrato, upm, k, sum(d) AS y, sum(d) FILTER (area = '1') AS ya, sum(d) FILTER (area = '2') AS yb, sum(d) FILTER (sexo = 'Mujer') AS yc
  FROM src, (VALUES (1), (2), (3)) q(k) WHERE pobreza_t1 = k GROUP BY 1, 2, 3),
uni AS (SELECT estrato, upm, count(*) OVER (PARTITION BY estrato) AS n FROM (SELECT DISTINCT estrato, upm FROM src)),
todos AS (
  SELECT u.estrato, u.upm, u.k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(ac, 0) AS ac, coalesce(bc, 0) AS bc,
         coalesce(y, 0) AS y, coalesce(ya, 0) AS ya, coalesce(yb, 0) AS yb, coalesce(yc, 0) AS yc
  FROM u LEFT JOIN cel USING (estrato, upm, k)),
rep AS (
  SELECT r.estrato, r.upm, any_value(r.n) AS n, t.k, {sums}
  FROM (SELECT * FROM uni UNION ALL SELECT '-', -1, 1) r CROSS JOIN (
    SELECT *, 1 AS uno FROM todos) t
  CROSS JOIN LATERAL (SELECT CASE WHEN t.estrato <> r.estrato THEN 1.0::DOUBLE WHEN t.upm = r.upm THEN 0 ELSE n / (n - 1.0::DOUBLE) END AS f) GROUP BY 1, 2, 4),
gap AS (SELECT *, t1 - a AS g1, t2 - b AS g2, t3 - c AS g3, a * (b * c - bc * bc) - b * ac * ac AS det FROM rep, tot),
est AS (
  SELECT estrato, upm, n, k, y + ya * (g1 * (b * c - bc * bc) - ac * (b * g3 - g2 * bc)) / det
         + yb * (a * (g2 * c - bc * g3) - ac * (ac * g2 - 0) + ac * bc * g1) / det
         + yc * (a * (b * g3 - bc * g2) - ac * b * g1) / det AS t FROM gap)
SELECT CAST(x.k AS VARCHAR) AS stat, round(any_value(z.t), 2) AS estimate, round(sqrt(sum((n - 1.0::DOUBLE) / n * (x.t - z.t) * (x.t - z.t))), 2) AS se
FROM est x JOIN (SELECT k, t FROM est WHERE estrato = '-') z ON x.k = z.k WHERE x.estrato <> '-' GROUP BY 1"""
CALIBRATED_JACKKNIFE_SQL = CALIBRATED_JACKKNIFE_SQL.replace("{sums}", ", ".join(f"sum(f * {c}) AS {c}" for c in "a b c ac bc y ya yb yc".split()))


@query("j27_jackknife_of_calibrated_totals", sql(
    CALIBRATED_JACKKNIFE_SQL, PANEL_FINAL, ", src AS (SELECT *, fep_aj AS d FROM final)", MARGINS_SQL))
def jackknife_of_calibrated_totals(spark, sf):
    states = {str(k): F.when(F.col("pobreza_t1") == k, 1.0) for k in (1, 2, 3)}
    rows, whole = calibrated_jackknife(_margin_design(spark, sf), states)
    out = replicate_variance(rows, whole, {n: (lambda cells, i=i: cells[i]) for i, n in enumerate(states)})
    return rounded(out.select("stat", "estimate", "se"), estimate=2, se=2)
