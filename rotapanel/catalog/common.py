"""Survey tables for the queries, and the same tables in SQL."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotapanel.operators.weights import annual_weights, quarterly_weights
from rotapanel.session import shared_dir
from rotapanel.sources.controls import derive_controls
from rotapanel.sources.microdata import survey_base

FIRST, SECOND = "T1", "T2"
PANEL_PROBABILITY = 0.75  # three of four panels stay between consecutive quarters


def base(spark: SparkSession, sf: str, quarters: list[str] | None = None) -> DataFrame:
    return survey_base(spark, sf, quarters)


def controls(spark: SparkSession, sf: str) -> DataFrame:
    return derive_controls(spark, sf)


def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    return quarterly_weights(base(spark, sf))


def annual(spark: SparkSession, sf: str) -> DataFrame:
    return annual_weights(base(spark, sf))


def scratch(spark: SparkSession, sf: str, name: str) -> str:
    """Folder for a table that a query writes and reads back."""
    tag = sf.strip("/").replace("/", "_")
    return f"{shared_dir(spark)}/rotapanel/{spark.sparkContext.applicationId}/{tag}/{name}"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


BASE = """
WITH numbered AS (
  SELECT o_orderkey AS k, o_custkey AS c, quarter(o_orderdate) AS q, o_orderstatus, o_totalprice,
         min(month(o_orderdate)) OVER (PARTITION BY o_custkey, quarter(o_orderdate)) AS m,
         row_number() OVER (PARTITION BY o_custkey, quarter(o_orderdate) ORDER BY o_orderkey) AS p
  FROM orders),
base AS (
  SELECT 'T' || q AS trimestre, 'M' || ((m - 1) % 3 + 1) AS mes_trimestre,
         n_regionkey || '_' || (CASE WHEN c % 8 < 5 THEN '1' ELSE '2' END) AS estrato,
         CAST(n_regionkey AS VARCHAR) AS dam,
         CASE WHEN c % 8 < 5 THEN '1' ELSE '2' END AS area,
         CAST(n_nationkey AS BIGINT) * 8 + c % 8 AS upm,
         c AS id_hogar, CAST(p AS INTEGER) AS id_pers,
         CAST(50 + (c * 7 + q * 13) % 100 AS DOUBLE) AS fep,
         CASE WHEN k % 20 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Ocupado'
              WHEN o_orderstatus = 'P' THEN 'Desocupado' WHEN o_orderstatus = 'O' THEN 'Inactivo' END AS trabajo,
         o_totalprice AS ingreso,
         CASE WHEN (c + p) % 2 = 0 THEN 'Hombre' ELSE 'Mujer' END AS sexo,
         CASE WHEN c % 7 = 0 THEN 'Indigena' WHEN c % 7 = 1 THEN 'Afro' ELSE 'Otra' END AS etnia,
         CAST(15 + (c * 3 + p * 17) % 70 AS INTEGER) AS edad,
         CASE WHEN (q = 1 AND k % 10 = 0) OR (q > 1 AND k % 5 = 0) THEN NULL
              WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 250000 THEN 2 ELSE 3 END AS pobreza
  FROM numbered JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey),
poblacion AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS dam, CASE WHEN c_custkey % 8 < 5 THEN '1' ELSE '2' END AS area,
         100.0::DOUBLE * count(*) AS N_hogares, 130.0::DOUBLE * count(*) AS N_personas
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
"""

# Tables used by several queries; each is a list of WITH entries.
QUARTERLY = """, fac AS (
  SELECT trimestre, mes_trimestre, num, sum(num) OVER (PARTITION BY trimestre) AS den,
         num / sum(num) OVER (PARTITION BY trimestre) AS ai
  FROM (SELECT trimestre, mes_trimestre, sum(fep) AS num FROM base GROUP BY 1, 2)),
ajus AS (SELECT b.*, ai, fep * ai AS dk_mes FROM base b JOIN fac USING (trimestre, mes_trimestre))
"""
ANNUAL = """, facb AS (
  SELECT trimestre, mes_trimestre, num, sum(num) OVER () AS den, num / sum(num) OVER () AS bi
  FROM (SELECT trimestre, mes_trimestre, sum(fep) AS num FROM base GROUP BY 1, 2)),
ajus2 AS (SELECT b.*, bi, fep * bi AS dk_anual FROM base b JOIN facb USING (trimestre, mes_trimestre))
"""
TARGETS = """, metas AS (
  SELECT dam || '_' || area AS estrato, round_even(N_hogares, 0) AS t_hog, round_even(N_personas, 0) AS t_per
  FROM poblacion)
"""
QUARTERLY_CAL = (
    QUARTERLY
    + TARGETS
    + """, hog AS (SELECT DISTINCT trimestre, mes_trimestre, upm, id_hogar, estrato, dam, dk_mes FROM ajus WHERE id_pers = 1),
hogcal AS (
  SELECT h.*, dk_mes * (t_hog / sum(dk_mes) OVER (PARTITION BY trimestre, h.estrato)) AS dk_mes_cali
  FROM hog h JOIN metas m ON h.estrato = m.estrato),
cali AS (
  SELECT a.*, c.dk_mes_cali FROM ajus a JOIN hogcal c USING (trimestre, mes_trimestre, upm, id_hogar))
"""
)
ANNUAL_CAL = (
    ANNUAL
    + TARGETS
    + """, tam AS (
  SELECT trimestre, mes_trimestre, estrato, dam, upm, id_hogar, count(*) AS n_personas FROM ajus2 GROUP BY ALL),
hog2 AS (
  SELECT t.*, a.dk_anual FROM tam t JOIN ajus2 a USING (trimestre, mes_trimestre, estrato, dam, upm, id_hogar)
  WHERE a.id_pers = 1),
lam AS (
  SELECT estrato, (any_value(t_per) - sum(dk_anual * n_personas)) / sum(dk_anual * n_personas * n_personas) AS l
  FROM hog2 JOIN metas USING (estrato) GROUP BY estrato),
hogcal2 AS (SELECT h.*, dk_anual * (1 + n_personas * l) AS dk_anual_calib FROM hog2 h JOIN lam USING (estrato)),
cali2 AS (
  SELECT a.*, dk_anual_calib, CASE WHEN trabajo = 'Desocupado' THEN 1 ELSE 0 END AS y,
         trimestre || '_' || mes_trimestre AS trim_mes
  FROM ajus2 a JOIN hogcal2 c USING (trimestre, mes_trimestre, upm, id_hogar) WHERE trabajo IS NOT NULL)
"""
)
PANEL = f""", hogares AS (SELECT DISTINCT upm, trimestre, id_hogar, fep FROM base WHERE trimestre IN ('T1', 'T2')),
ambos AS (SELECT id_hogar FROM hogares GROUP BY id_hogar HAVING count(*) = 2),
hogpanel AS (
  SELECT h.*, t.fep AS fep_t1, CASE WHEN a.id_hogar IS NULL THEN 0 ELSE 1 END AS respboth,
         CASE WHEN a.id_hogar IS NULL THEN 0.0 ELSE t.fep / {PANEL_PROBABILITY}::DOUBLE END AS fep_long
  FROM hogares h JOIN (SELECT id_hogar, fep FROM hogares WHERE trimestre = 'T1') t USING (id_hogar)
  LEFT JOIN ambos a ON h.id_hogar = a.id_hogar),
perambos AS (
  SELECT id_hogar, id_pers FROM base WHERE trimestre IN ('T1', 'T2') AND id_hogar IN (SELECT id_hogar FROM ambos)
  GROUP BY 1, 2 HAVING count(DISTINCT trimestre) = 2),
gente AS (
  SELECT b.*, CASE WHEN p.id_hogar IS NULL THEN 0 ELSE 1 END AS respboth_per, hp.fep_long
  FROM base b JOIN hogpanel hp ON b.id_hogar = hp.id_hogar AND b.trimestre = hp.trimestre
  LEFT JOIN perambos p ON b.id_hogar = p.id_hogar AND b.id_pers = p.id_pers
  WHERE b.id_hogar IN (SELECT id_hogar FROM ambos))
"""
# The panel with mean response rates per stratum as propensities.
PANEL_FINAL = (
    PANEL
    + TARGETS
    + """, tasas AS (SELECT estrato, avg(CAST(respboth_per AS DOUBLE)) AS prob_resp FROM gente GROUP BY 1),
puntaje AS (SELECT g.*, prob_resp, fep_long / prob_resp AS fep_aj FROM gente g JOIN tasas USING (estrato)),
panel AS (
  SELECT id_hogar, id_pers, a.upm, a.estrato, a.edad, a.sexo, a.area, a.fep_aj,
         a.pobreza AS pobreza_t1, b.pobreza AS pobreza_t2
  FROM (SELECT * FROM puntaje WHERE trimestre = 'T1' AND respboth_per = 1) a
  JOIN (SELECT * FROM puntaje WHERE trimestre = 'T2' AND respboth_per = 1) b USING (id_hogar, id_pers)),
final AS (
  SELECT p.*, fep_aj * (t_per / sum(fep_aj) OVER (PARTITION BY p.estrato)) AS fex_cali
  FROM panel p JOIN metas m ON p.estrato = m.estrato)
"""
)


def sql(body: str, *tables: str) -> str:
    """A full statement: base tables, shared tables, then the query's own."""
    return BASE + "".join(tables) + body


def t_within(t: str, df: str) -> str:
    """Probability that Student's t lies within ±t, by its finite series for whole degrees of freedom."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = (
        f"sin({angle}) * coalesce(list_sum(list_transform(range(0, {df} // 2), lambda k: "
        f"exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) + 2 * k * ln(cos({angle}))))), 0)"
    )
    odd = (
        f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), "
        f"lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + 2 * k * ln(cos({angle}))))), 0))"
    )
    return f"(CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def t_points(src: str, name: str = "puntos") -> str:
    """WITH entry: two-sided 5 % points for the values of ``df`` in ``src``, by bisection."""
    return f""", {name} AS (
  WITH RECURSIVE b AS (
    SELECT DISTINCT df, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS paso FROM {src}
    UNION ALL
    SELECT df, CASE WHEN dentro < 0.95 THEN medio ELSE lo END, CASE WHEN dentro < 0.95 THEN hi ELSE medio END, paso + 1
    FROM (SELECT *, (lo + hi) / 2 AS medio, {t_within('((lo + hi) / 2)', 'df')} AS dentro FROM b WHERE paso < 60))
  SELECT df, hi AS t_crit FROM b WHERE paso = 60)
"""


def variance(
    src: str, by: list[str], u: str, domain: str = "TRUE", name: str = "var_out", lonely: str = "NULL"
) -> str:
    """WITH entries for the design variance of sum(u) per domain, from unit totals."""
    keys = "".join(f", {c}" for c in by)
    group = "".join(f"{c}, " for c in by)
    return f""", {name}_n AS (
  SELECT estrato, count(*) AS n FROM (SELECT DISTINCT estrato, upm FROM {src}) GROUP BY estrato),
{name}_z AS (SELECT estrato, upm{keys}, sum({u}) AS z FROM {src} WHERE {domain} GROUP BY estrato, upm{keys}),
{name}_h AS (
  SELECT estrato{keys}, CASE WHEN any_value(n) > 1 THEN any_value(n) / (any_value(n) - 1.0::DOUBLE)
         * (sum(z * z) - sum(z) * sum(z) / any_value(n)) ELSE {lonely} END AS v
  FROM {name}_z JOIN {name}_n USING (estrato) GROUP BY estrato{keys}),
{name} AS (SELECT {group}sum(v) AS v FROM {name}_h{" GROUP BY " + ", ".join(by) if by else ""})
"""


@lru_cache(None)
def covariance(src: str, z: str, name: str = "vc") -> str:
    """WITH entries for a covariance table from unit totals ``z(estrato, upm, stat, z)``.

    ``src`` gives the units of the design. Missing unit totals count as zero.
    """
    return f""", {name}_u AS (SELECT DISTINCT estrato, upm FROM {src}),
{name}_d AS (
  SELECT u.estrato, u.upm, s.stat, coalesce(t.z, 0) AS z
  FROM {name}_u u CROSS JOIN (SELECT DISTINCT stat FROM {z}) s
  LEFT JOIN {z} t ON t.estrato = u.estrato AND t.upm = u.upm AND t.stat = s.stat),
{name}_c AS (
  SELECT estrato, upm, stat, z - avg(z) OVER (PARTITION BY estrato, stat) AS e,
         count(*) OVER (PARTITION BY estrato, stat) AS n FROM {name}_d),
{name} AS (
  SELECT a.stat AS stat_a, b.stat AS stat_b, sum(a.n / (a.n - 1.0::DOUBLE) * a.e * b.e) AS cov
  FROM {name}_c a JOIN {name}_c b ON a.estrato = b.estrato AND a.upm = b.upm GROUP BY 1, 2)
"""
