import math

import pytest
from pyspark.sql import functions as F

from rotapanel.llm import mixing


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(f"s{k}", 10 ** (k + 1)) for k in range(4)]
    total = sum(n for _, n in rows)
    return spark.createDataFrame([(s, n, n / total) for s, n in rows], "_src string, _tokens long, share double")


def weights(shares, a):
    u = [q**a for q in shares]
    return [x / sum(u) for x in u]


def test_exponent_meets_the_entropy(sources):
    shares = [r.share for r in sources.collect()]
    for target in (0.5, 0.9, 1.2):
        a = mixing.exponent(sources, 1.0, min_entropy=target)
        assert math.isclose(-sum(w * math.log(w) for w in weights(shares, a)), target, abs_tol=1e-6)
    assert mixing.exponent(sources, 1.0, min_entropy=0.0) == 1.0


def test_exponent_meets_the_repetition_limit(sources):
    rows = sources.collect()
    shares, tokens = [r.share for r in rows], [r._tokens for r in rows]
    budget = float(sum(tokens))
    for limit in (1.5, 4.0, 20.0):
        a = mixing.exponent(sources, budget, max_repeats=limit)
        most = max(w * budget / n for w, n in zip(weights(shares, a), tokens))
        assert most <= limit and math.isclose(most, limit, rel_tol=1e-5)


def test_sources_keep_to_their_budgets(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "big").otherwise("small").alias("source"),
        F.concat_ws(" ", F.array_repeat(F.lit("w"), 10)).alias("text"),
    )
    got = mixing.mix_sources(docs, max_repeats=2.0, block_tokens=200)
    rows = got.groupBy("source").agg(F.count("*").alias("n"), F.max("epoch").alias("e")).collect()
    n = {r.source: r.n * 10 for r in rows}
    # twice the small source, and the rest of the budget from the large one, but for a block each
    assert 10_000 - 400 <= n["small"] <= 10_000 and 20_000 - 400 <= n["big"] <= 20_000
    assert got.groupBy("doc_id", "epoch").count().where("count > 1").isEmpty()


def test_words_are_counted(spark):
    texts = [None, "", " ", "a", " a  b\n", "a\tb c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 0, 1, 2, 3]


def test_odd_rows(odd, no_rows):
    got = mixing.mix_sources(odd, max_repeats=3.0)
    assert set(odd.columns) | {"epoch", "block", "block_key"} == set(got.columns)
    assert got.count() > 0 and got.where("epoch IS NULL OR epoch < 0").isEmpty()
    assert mixing.mix_sources(no_rows).count() == 0
    assert mixing.mix_sources(odd.where("text = ''")).count() == 0


def quotas(rows, max_repeats):
    """(quota, tokens, largest document) of each source, of rows (source, words)."""
    tokens, most = {}, {}
    for s, n in rows:
        tokens[s], most[s] = tokens.get(s, 0) + n, max(most.get(s, 0), n)
    total = sum(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        w = {s: (n / total) ** a for s, n in tokens.items()}
        if max(w[s] / sum(w.values()) * total / n for s, n in tokens.items()) <= max_repeats:
            hi = a
        else:
            lo = a
    w = {s: (n / total) ** hi for s, n in tokens.items()}
    return {s: (w[s] / sum(w.values()) * total, n, most[s]) for s, n in tokens.items()}


@pytest.mark.parametrize("folder", ["tiny", "sf"])
def test_sources_meet_their_weights(spark, request, folder):
    docs = spark.read.parquet(f"{request.getfixturevalue(folder)}/documents.parquet")
    count = mixing.word_count(F.col("text")).alias("n")
    want = quotas([tuple(r) for r in docs.select("source", count).collect()], mixing.MAX_REPEATS)
    got = {r.source: r.n for r in mixing.mix_sources(docs).select("source", count).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    for s, (quota, _, most) in want.items():
        assert abs(got.get(s, 0) - quota) <= most / 2 + 1, s


def test_weights_are_met_with_one_id_and_equal_rows(spark):
    rows = [(1, f"a{k % 40} " + "w " * 9, "big") for k in range(2000)] + [(k, "v " * 10, "small") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, max_repeats=2.0)
    n = {r.source: 10 * r["count"] for r in got.groupBy("source").count().collect()}
    want = quotas([(s, 10) for _, _, s in rows], 2.0)
    assert all(abs(n[s] - want[s][0]) <= 6 for s in want)


def test_rows_without_a_key_are_dealt_by_their_text(spark):
    rows = [(None, f"u{k} " + "w " * 9, "big") for k in range(2000)] + [(k, "v " * 10, "small") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, max_repeats=2.0, block_tokens=1_000)
    assert got.where("source = 'big'").select("block").distinct().count() > 10
    want = quotas([(s, 10) for _, _, s in rows], 2.0)
    n = {r.source: 10 * r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(n[s] - want[s][0]) <= 6 for s in want)
