"""Registered queries of the operators, with SQL where SQL gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotapanel.llm import centroids, decontaminate, fill_middle, mixing, near_dup, quality, repeats, sharding, toxicity, url_filter, vectors, warc, word_repeats
from rotapanel.llm.steps import written

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_mix_sources",
    f"WITH {mixing.mix_sql('documents', ['doc_id', 'text', 'lang', 'source', 'n_chars'])} SELECT doc_id, source, epoch, block FROM mixed",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select("doc_id", "source", "epoch", "block")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)


def _rank_sql(name: str, edges: str, seeds: str) -> str:
    """WITH entries: rounds of personalised PageRank."""
    out = f"{name}0 AS (SELECT host, seed * {1 - url_filter.DAMPING}::DOUBLE AS score FROM {seeds})"
    for k in range(url_filter.ROUNDS):
        out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (
  SELECT dst AS host, {url_filter.DAMPING}::DOUBLE * score * p AS score FROM {name}{k} JOIN {edges} ON src = host
  UNION ALL SELECT host, score FROM {name}0) GROUP BY host)"""
    return out


@query(
    "op2_judge_urls",
    f"""WITH rules(rh, rp, v) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, html,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path),
judged AS (SELECT u.*, rule, v FROM u LEFT JOIN best USING (host, path)),
good AS (SELECT host, count(*) / sum(count(*)) OVER ()::DOUBLE AS seed FROM judged WHERE v = 'allow' GROUP BY host),
bad AS (SELECT host, count(*) / sum(count(*)) OVER ()::DOUBLE AS seed FROM judged WHERE v = 'block' GROUP BY host),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"''<>\\s]*)', 1)) AS l FROM u),
away AS (SELECT src, translate(regexp_extract(l, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1),
                              '{url_filter.UPPER}', '{url_filter.LOWER}') AS dst FROM links),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM away WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
ahead AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges),
aback AS (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS p FROM edges),
{_rank_sql("t", "ahead", "good")},
{_rank_sql("d", "aback", "bad")}
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(d.score, 0) > {url_filter.RATIO}::DOUBLE * coalesce(t.score, 0)
       THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN t{url_filter.ROUNDS} t USING (host) LEFT JOIN d{url_filter.ROUNDS} d USING (host)""",
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op3_shard",
    f"WITH RECURSIVE {sharding.lookup_sql()} SELECT doc_id, slot, shard FROM documents JOIN lookup ON slot = "
    f"('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:15])::BIGINT % {sharding.SLOTS}",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents"), instead="text").select("doc_id", "slot", "shard")


_LINKS = f"""d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT DISTINCT x, y FROM (
  SELECT a.doc_id AS x, b.doc_id AS y, a.r AS ra, b.r AS rb, count(*) AS i FROM s a JOIN s b USING (g)
  WHERE a.r <> b.r AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n na ON ra = na.r JOIN n nb ON rb = nb.r
  WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM reach JOIN links ON b = x),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


@query(
    "op4_near_duplicates",
    f"""WITH RECURSIVE {_LINKS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN least_id l ON l.doc_id = d.doc_id""",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.group_documents(table(spark, sf, "documents"), percent=85)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_WORDS = _WORDS.format(u=url_filter.UPPER, l=url_filter.LOWER)


@query(
    "op5_decontaminate",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
met AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, g)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM met) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit_quality(docs, table(spark, sf, "labels"), quality.label_grade())
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", *quality.ADDED, (F.col("p_tail") >= quality.LEAST).alias("kept"))


@query(
    "op7_warc",
    f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id > first THEN first END AS refers_to FROM f""",
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf, "pages"), warc.archive_folder(spark, "warc"))
    records = warc.read_archives(archives, payloads=False)
    records = written(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.check_revisits(records)
    return records


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")

    def held_out(key: str) -> Column:
        return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))

    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels").where(~held_out("doc_id")))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op9_repeated_bytes")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query(
    "op10_near_vectors",
    f"""WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {vectors.LEAST}::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT a, y FROM reach JOIN links ON b = x),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM embeddings LEFT JOIN least_id ON a = vec_id LEFT JOIN counts ON x = vec_id""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.group_vectors(table(spark, sf, "embeddings"))


def _group_sql(k: int) -> str:
    return f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT"


@query(
    "op11_fill_in_middle",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS w FROM documents),
c AS (SELECT doc_id, t, w, len(w)::BIGINT AS n, {_group_sql(0)} % (len(w) + 1) AS x, {_group_sql(1)} % (len(w) + 1) AS y,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR {_group_sql(2)} % 100 >= 50 THEN 'plain'
       WHEN {_group_sql(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, t, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b,
  array_to_string(w[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b ELSE '<S>' || s || '<P>' || a || '<M>' || b END)
    AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"),
    )


def _rounds_sql(rounds: int) -> str:
    """WITH entries: centroids c and choices a of each round; a distance and a number are one key."""
    out = ""
    for t in range(rounds + 1):
        out += f""",
a{t} AS MATERIALIZED (SELECT r, min(d * 8 + j) AS m FROM (
  SELECT r, j, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{t} c USING (i) GROUP BY r, j) GROUP BY r)"""
        if t < rounds:
            out += f""",
c{t + 1} AS MATERIALIZED (SELECT j, i, coalesce(m, c.v) AS v FROM c{t} c LEFT JOIN (
  SELECT j, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
    SELECT m % 8 AS j, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY 1, 2)) USING (j, i))"""
    return out


@query(
    "op12_cluster_vectors",
    f"""WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS v FROM k),
first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v FROM k ORDER BY j LIMIT 8),
c0 AS MATERIALIZED (SELECT j, unnest(range(1, 65)) AS i, unnest(v) AS v FROM first)
{_rounds_sql(10)},
digest AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS s FROM c10 GROUP BY j)
SELECT vec_id, (m % 8)::INT AS cluster, m // 8 AS distance, (sum(m // 8) OVER (PARTITION BY m % 8))::BIGINT AS cluster_inertia,
       (sum(m // 8) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM k JOIN a10 USING (r) JOIN digest ON j = m % 8""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster_table(table(spark, sf, "embeddings"))


@query(
    "op13_repeated_words",
    """WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, k, md5(array_to_string(w[k:k + 34], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS place FROM g JOIN again USING (g)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY place) AS t, count(*) AS n
         FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return word_repeats.remove_repeated_words(table(spark, sf, "documents"))
