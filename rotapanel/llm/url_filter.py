"""Verdicts on urls by rules, and by trust spread over links between hosts.

A rule (host, path) fits a url whose host is the rule's or below it, and whose
path starts with the rule's; the longest rule wins. Urls without a rule get the
verdict of their host: personalised PageRank spreads trust along links from
hosts with allowed pages, and distrust against the links from hosts with
blocked pages (who links to blocked hosts is suspect). A host whose distrust
exceeds ``ratio`` times its trust is blocked; without evidence it is allowed.

Rules and link edges are joined at the level of hosts, after sums per host and
per edge; a host with many pages costs one partial sum per task.

Cases: a null url, or one without ``://``, has empty host and path, no rule and the
verdict allow; null or empty html has no links; repeated rows are judged each, and
count in the sums; empty tables give empty results. Extra columns stay;
``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.session import settle

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING, ROUNDS, RATIO = 0.85, 20, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ["host", "path", "rule", "verdict", "trust", "distrust"]


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): counted links to other hosts."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'<>\s]*)"), 1)
    away = F.filter(links, lambda x: x.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:)?//"))
    full = F.transform(away, lambda x: F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x))
    return (
        pages.select(url_host(F.col(url)).alias("src"), F.explode(full).alias("link"))
        .select("src", url_host(F.col("link")).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank (host, score) of seeds (host, seed) with sum 1 over edges (src, dst, weight).

    What hosts without links hold leaves the graph.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = settle(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    base = settle(seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")))
    scores = base.withColumnRenamed("base", "score")
    if steps.isEmpty():
        return scores
    for k in range(rounds):
        flow = (
            scores.join(steps, scores.host == steps.src)
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("score") * F.col("p")).alias("flow"))
        )
        scores = flow.join(base, "host", "full").select(
            "host", (damping * F.coalesce("flow", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("score")
        )
        if k % 5 == 4:
            scores = settle(scores)
    return scores


def _rule_table(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = df.sparkSession.createDataFrame(
        [(h, p, v, h + p, len(h + p)) for h, p, v in rules],
        "rule_host string, rule_path string, rule_verdict string, rule string, length int",
    )
    return rows.groupBy("rule_host").agg(
        F.collect_list(F.struct("length", "rule", "rule_path", "rule_verdict")).alias("rules")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    url: str = "url",
    html: str = "html",
    ratio: float = RATIO,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Adds host, path, rule, verdict and the host's trust and distrust."""
    pages = pages.drop(*[c for c in ADDED if c not in (url, html)])
    split = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")
    )
    hosts = split.groupBy("host").agg(F.lit(1).alias("one")).where("host <> ''")
    fitting = (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(_rule_table(pages, rules), "rule_host")
        .groupBy("host")
        .agg(F.sort_array(F.flatten(F.collect_list("rules")), asc=False).alias("rules"))
    )
    fitting = settle(fitting)

    def ruled(df: DataFrame) -> DataFrame:
        best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
        return df.join(fitting, "host", "left").withColumn("best", best).drop("rules")

    # Seeds: a host's share of all allowed, and of all blocked, pages.
    counts = settle(
        ruled(split.groupBy("host", "path").agg(F.count("*").alias("n")))
        .where("best IS NOT NULL")
        .groupBy("host", F.col("best.rule_verdict").alias("v"))
        .agg(F.sum("n").cast("double").alias("n"))
    )

    def seeds(verdict: str) -> DataFrame:
        own = counts.where(F.col("v") == verdict)
        pages_in_all = own.agg(F.sum("n")).first()[0] or 1.0
        return own.select("host", (F.col("n") / F.lit(pages_in_all)).alias("seed"))

    edges = settle(host_edges(pages, url, html))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = spread(edges, seeds("allow"), damping, rounds).withColumnRenamed("score", "trust")
    distrust = spread(back, seeds("block"), damping, rounds).withColumnRenamed("score", "distrust")
    scores = settle(
        hosts.select("host")
        .join(fitting, "host", "left").join(trust, "host", "left").join(distrust, "host", "left")
        .fillna(0.0, ["trust", "distrust"])
        .withColumnRenamed("rules", "_host_rules")
    )
    best = F.get(F.filter("_host_rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    by_host = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return (
        split.join(scores, "host", "left")
        .withColumn("_best_rule", best)
        .withColumn("rule", F.col("_best_rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("_best_rule.rule_verdict"), by_host))
        .fillna(0.0, ["trust", "distrust"])
        .select(*pages.columns, *ADDED)
    )
