import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import LONG
from rotapanel.llm import word_repeats
from rotapanel.llm.word_repeats import DEPTH, WINDOW


def by_hand(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    spans = [[tuple(w[k : k + WINDOW]) for k in range(len(w) - WINDOW + 1)] for w in words]
    seen = Counter(s for own in spans for s in own)
    out = []
    for (i, _), w, own in zip(rows, words, spans):
        gone = np.zeros(len(w) + 1, bool)
        for k, s in enumerate(own):
            if seen[s] > 1:
                gone[k : k + WINDOW] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit("x")).withColumn("d0", F.lit("y"))
    return sorted((tuple(r) for r in word_repeats.remove_repeated_words(df, **options).collect()), key=str)


def texts(seed, count, vocabulary=40):
    """Texts that share passages, with words changed here and there, and passages that follow others by chance."""
    rng = np.random.default_rng(seed)
    passages = [rng.integers(0, vocabulary, rng.integers(30, 90)) for _ in range(12)]
    out = []
    for i in range(count):
        parts = []
        for _ in range(rng.integers(0, 6)):
            p = passages[rng.integers(len(passages))].copy()
            if rng.random() < 0.4:
                p[rng.integers(len(p))] = 999 + rng.integers(3)
            parts += [p[rng.integers(0, 5) :], rng.integers(0, 10**6, rng.integers(0, 30))]
        words = np.concatenate(parts) if parts else []
        out.append((i, "".join(f"w{w}" + rng.choice([" ", "\n", "  \t", " "]) for w in words)))
    return out


@pytest.mark.parametrize("seed, group", [(1, word_repeats.GROUP), (2, 4), (3, 1)])
def test_equals_all_windows(spark, seed, group):
    rows = texts(seed, 150)
    got = found(spark, rows, group=group)
    assert got == by_hand(rows) and any(0 < r[2] < r[1] for r in got)


def test_repeats_of_few_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b"], p=[0.97, 0.03], size=400))) for i in range(12)] + [(99, "a " * 3_000), (98, "a b " * 500)]
    for group in (word_repeats.GROUP, 8):
        assert found(spark, rows, group=group) == by_hand(rows)


def test_odd_rows(spark, odd, no_rows):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(50, LONG[:-3]), (51, " ".join(map(str, range(35)))), (52, "x " + " ".join(map(str, range(35)))), (53, " ".join(map(str, range(34)))), (54, "É ü " * 40)]
    assert found(spark, rows) == by_hand(rows)
    assert word_repeats.remove_repeated_words(no_rows).count() == 0


def test_texts_and_stretches(spark):
    same = " ".join(f"s{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"a b\n{same} c"), (2, f"{same}\td")], "doc_id long, text string")
    one, two = sorted(word_repeats.remove_repeated_words(df, texts=True).collect())
    assert (one.kept, [tuple(s) for s in one.stretches]) == ("a b c", [(2, 42)]) and (two.kept, [tuple(s) for s in two.stretches]) == ("d", [(0, 40)])


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 5_000)]
    column = pa.array([" ".join(words[:3_000]), None, "", " ".join(words[3_000:])])
    whole = word_repeats.Words(column)
    runs = [np.concatenate(x) for x in zip(*word_repeats.anchored(whole.hash, whole.first))]
    monkeypatch.setattr(word_repeats, "PIECE", 300)
    parts = [np.concatenate(x) for x in zip(*word_repeats.anchored(whole.hash, whole.first))]

    def windows(r):
        return sorted((t, a, p - x) for t, a, _, p, most, least in zip(*r) for x in range(least, most + 1))

    assert windows(runs) == windows(parts) and len(windows(runs)) == 5_000 - 2 * (WINDOW - 1)


def test_nodes_of_a_tree():
    symbols = np.zeros((6, DEPTH), np.int64)
    symbols[2, DEPTH - 1], symbols[5, 0] = 1, 7
    order, shared = word_repeats.subtree(np.array([1, 1, 1, 2, 2, 2]), symbols)
    assert shared.tolist() == [0, DEPTH, DEPTH - 1, 0, DEPTH, 0] and order[5] == 5
    assert word_repeats.nodes(shared, DEPTH) == [(0, 2), (3, 5)] and word_repeats.nodes(shared, DEPTH - 1) == [(0, 3), (3, 5)]


def test_a_crowd_is_split_by_longer_prefixes(spark):
    """No task takes more suffixes of a group than its bound, whatever they share."""
    rows = [(i, " ".join(["same"] * 60 + [f"u{i}-{k}" for k in range(20)])) for i in range(200)]
    assert found(spark, rows, group=50) == by_hand(rows)
