import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, window=10):
    grams = [(i, tuple(w[k : k + min(len(w), window)])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_hits(df, bench).collect()
    assert all(r.n_items == len(r["items"]) for r in rows)
    return sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows], key=str)


@pytest.mark.parametrize("vocabulary, broadcast", [(2, True), (3, False), (40, True)])
def test_equals_a_search_of_all_windows(spark, monkeypatch, vocabulary, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    rng = np.random.default_rng(vocabulary)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(1, 30)))) for k in range(12)]
    docs = []
    for k in range(40):
        text = [f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(0, 50))]
        if k % 2:
            other = items[k % 12][1].split()
            cut = int(rng.integers(0, len(other)))
            text[5:5] = other[cut : cut + int(rng.integers(1, 20))]
        docs.append((k, ", ".join(text).upper() if k % 3 else " ".join(text)))
    assert found(spark, docs, items) == by_hand(docs, items)


def test_odd_rows(spark):
    span = "One two three four five six seven eight nine ten"
    items = [(1, span + " eleven"), (2, span + " eleven"), (3, None), (4, ""), (5, "!?"), (6, "Éa 7"), (None, span)]
    docs = [(1, "x " + span), (1, "x " + span), (2, None), (3, ""), (None, span), (None, "éa 7 Éa 7"), (4, span[:-4]), (5, span + " y " + span)]
    got = found(spark, docs, items)
    assert [r for r in got if r[0] is not None] == [(1, 11, 10, "1,2"), (1, 11, 10, "1,2"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 9, 0, ""), (5, 21, 20, "1,2")]
    assert sorted(r[2] for r in got if r[0] is None) == [2, 10]
    assert found(spark, [], items) == [] and found(spark, [(1, span)], []) == [(1, 10, 0, "")]


def test_removal_keeps_clean_rows(odd, no_rows, spark):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    left = decontaminate.remove_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [3, 4, 5, 6, 7, 8]
    assert left.where("doc_id IS NULL").count() == 1 and decontaminate.remove_contaminated(no_rows, bench).count() == 0


def test_long_texts_and_places(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    item = " ".join(f"w{k}" for k in range(150_000, 150_012))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = decontaminate.find_hits(df, spark.createDataFrame([(9, item)], "item_id long, text string")).select(
        "n_words", "n_hit", F.size("spans").alias("n"), F.col("spans")[0]["start"].alias("at")
    ).first()
    assert tuple(row) == (200_000, 12, 3, 150_000)


def test_clashing_columns_and_a_hit_at_each_end_of_a_long_text(spark):
    item = " ".join(f"b{k}" for k in range(12))
    text = item + " " + " ".join(f"w{k}" for k in range(50_000)) + " " + item
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("h", "p", "w", "ctx", "item", "doc", "e", "fp")})
    bench = spark.createDataFrame([(9, item)], "item_id long, text string").withColumns({c: F.lit("own") for c in ("h", "q", "kind", "iw")})
    row = decontaminate.find_hits(df, bench).first()
    assert (row.n_words, row.n_hit, row["items"]) == (50_024, 24, ["9"]) and [s.start for s in row.spans] == [0, 1, 2, 50_012, 50_013, 50_014]
