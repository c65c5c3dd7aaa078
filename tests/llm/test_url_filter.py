import numpy as np
from pyspark.sql import functions as F

from rotapanel.llm import url_filter


def page(k, url, *links):
    return (k, url, "".join(f'<p><a class="x" href="{x}">t</a>' for x in links), "own")


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    return {r.page_id: r for r in url_filter.judge_urls(df, **more).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [
        page(1, "http://EXAMPLE.org/es/a?q#f"), page(2, "https://a.example.org/en/12"), page(3, "x://b.org"), page(4, "http://b.com/fr/1"),
        page(5, "http://b.com/de/"), page(6, "http://notorg/x"), page(7, None), page(8, "no scheme"), page(9, "http://Ä.com/"), page(10, "a://b://c"),
        page(11, "http://example.org/en/2"), page(12, "http://x.org/?a"), page(13, "//a.org/"),
    ]
    got = judged(spark, rows)
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(1, 14)] == [
        ("example.org", "/es/a", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"), ("b.org", "", None),
        ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/", "com/de/"), ("notorg", "/x", None), ("", "", None), ("", "", None),
        ("Ä.com", "/", None), ("b:", "//c", None), ("example.org", "/en/2", "org/"), ("x.org", "/", "org/"), ("", "", None),
    ]
    assert [got[k].verdict for k in (1, 2, 4, 5, 7, 11)] == ["block", "block", "allow", "block", "allow", "allow"]


def test_distrust_goes_against_links_and_trust_along(spark):
    rows = [
        page(1, "http://good.org/", "http://near.net/a", "/own"), page(2, "http://near.net/"),
        page(3, "http://farm.net/", "http://bad.com/x", "//bad.com/y"), page(4, "http://bad.com/de/1"), page(5, "http://alone.net/"),
    ]
    got = judged(spark, rows)
    assert got[2].verdict == "allow" and got[2].trust > 0 and got[2].distrust == 0
    assert got[3].verdict == "block" and got[3].distrust > got[3].trust
    assert got[5].verdict == "allow" and got[5].trust == got[5].distrust == 0


def test_scores_equal_a_dense_iteration(spark):
    rng = np.random.default_rng(3)
    n, w = 30, rng.integers(0, 4, (30, 30)) * (rng.random((30, 30)) < 0.15)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame(
        [(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, weight double"
    )
    seed = np.zeros(n)
    seed[:3] = [0.5, 0.3, 0.2]
    seeds = spark.createDataFrame([(f"h{k}", float(seed[k])) for k in range(3)], "host string, seed double")
    p = w / np.maximum(w.sum(1, keepdims=True), 1)
    x = 0.15 * seed
    for _ in range(20):
        x = 0.15 * seed + 0.85 * x @ p
    got = {r.host: r.score for r in url_filter.spread(edges, seeds).collect()}
    assert all(abs(got.get(f"h{k}", 0.0) - x[k]) < 1e-12 for k in range(n))


def test_odd_rows(spark):
    rows = [page(1, "http://a.org/x"), page(1, "http://a.org/x"), (None, None, None, None), (2, "http://a.net", None, "r"), (3, "http://a.net", "", "r")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule string").withColumns({c: F.lit("?") for c in ("host", "rules", "best", "n")}))
    assert got.count() == 5 and got.where("host = '?' OR rules <> '?' OR best <> '?' OR n <> '?'").isEmpty()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(none).count() == 0
