import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.llm import repeats

W = 200


def by_hand(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + W] for _, t in texts for k in range(len(t) - W + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - W + 1):
            if seen[t[k : k + W]] > 1:
                gone[k : k + W] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str)


def passages(seed, n=60, common=6, alphabet="abcdeé "):
    """Texts of random letters with pieces of common passages, cut at any place."""
    rng = np.random.default_rng(seed)
    letters = np.array(list(alphabet))

    def text(length):
        return "".join(rng.choice(letters, length))

    pool = [text(int(rng.integers(150, 900))) for _ in range(common)]
    rows = []
    for k in range(n):
        parts = [text(int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 3))):
            p = pool[int(rng.integers(0, common))]
            a = int(rng.integers(0, len(p)))
            parts += [p[a : a + int(rng.integers(100, 700))], text(int(rng.integers(0, 60)))]
        rows.append((k, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, crowd", [(1, 1000), (2, 3), (3, 1)])
def test_equals_a_count_of_all_windows(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = passages(seed)
    assert found(spark, rows) == by_hand(rows)


def test_one_passage_in_ever_different_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 5)
    rng = np.random.default_rng(4)
    letters = np.array(list("xyz"))
    passage = "".join(rng.choice(letters, 230))
    rows = [(k, "".join(rng.choice(letters, 40)) + passage + "".join(rng.choice(letters, 40))) for k in range(40)]
    assert found(spark, rows) == by_hand(rows)


def test_periodic_texts_and_edges(spark):
    rows = [
        (1, "a" * 500), (2, "ab" * 150), (3, "b" * 199), (4, "b" * 200), (5, "c" * 201), (6, "abc" * 70 + "Q" + "abc" * 70),
        (7, None), (8, ""), (9, "Z" * 100 + "é" * 60), (10, "Y" * 100 + "é" * 60), (None, "w" + "é" * 120), (None, None),
    ]
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(odd, no_rows, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.text is None or len(r.text) < 10_000]
    got = sorted((tuple(r) for r in repeats.remove_repeats(odd).where("n_bytes < 10000").collect()), key=str)
    assert got == by_hand(rows)
    long = repeats.remove_repeats(odd).where("doc_id = 7").first()
    assert long.n_removed == long.n_bytes and long.n_spans == 1
    assert repeats.remove_repeats(no_rows).count() == 0
    same = [(1, "text " * 10 + "x" * 30 + "".join(map(str, range(200))))] * 3 + [(2, "u" * 10)]
    assert found(spark, same) == by_hand(same)


def test_spans_and_texts_come_along(spark):
    common = "".join(map(str, range(1000, 1100)))
    df = spark.createDataFrame([(1, "left" + common), (2, common + "right")], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(df, texts=True).collect()}
    assert bytes(rows[1].kept) == b"left" and [tuple(s) for s in rows[1].spans] == [(4, 404)]
    assert bytes(rows[2].kept) == b"right" and [tuple(s) for s in rows[2].spans] == [(0, 400)]


def test_long_text_in_pieces(spark, monkeypatch):
    from rotapanel.llm import anchors

    rng = np.random.default_rng(6)
    text = "".join(rng.choice(np.array(list("klmnop")), 30_000))
    rows = [(1, text + text[100:900] + "!"), (2, "?" + text[20_000:20_500])]
    want = by_hand(rows)
    assert found(spark, rows) == want
    import pyarrow as pa

    def windows(column):
        return sorted(
            (int(a), int(p), int(f + k)) for r in anchors.anchor_runs(column)
            for a, p, f, n in zip(r["anchor"], r["place"], r["first"], r["last"] - r["first"] + 1) for k in range(n)
        )

    column = pa.array([text, None, "", text[:500]])
    whole = windows(column)
    monkeypatch.setattr(anchors, "PIECE", 3000)
    assert set(windows(column)) == set(whole)


def test_parts_of_a_text_are_merged_in_their_task(spark):
    rows = [(d, k, k + 200) for d in (5, -7) for k in range(3_000)] + [(5, 4_000, 4_200), (9, 0, 200), (9, 200, 400), (9, 500, 700), (9, 100, 650)]
    parts = spark.createDataFrame(rows, "doc long, lo int, hi int").coalesce(1)
    found = sorted(tuple(r) for r in repeats.merged_parts(parts).collect())
    assert found == [(-7, 0, 3_199), (5, 0, 3_199), (5, 4_000, 4_200), (9, 0, 700)]
    assert repeats.merged_parts(parts.where("doc = 0")).count() == 0


def test_rows_of_one_hash_keep_spans_of_their_own(spark, monkeypatch):
    """With a first hash of two bits nearly all rows collide, and the second one tells them apart."""
    texts = [f"{k} " * 90 + ("shared passage " * 20 if k % 3 else "") for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    want = sorted(tuple(r) for r in repeats.remove_repeats(docs).collect())
    whole = repeats.identity
    monkeypatch.setattr(repeats, "identity", lambda seed: whole(seed) if seed else F.pmod(whole(0), F.lit(4)))
    numbered = repeats.with_identity(docs.select(F.col("doc_id").alias("id"), "text"))
    assert numbered.select("doc").distinct().count() == 40
    assert sorted(tuple(r) for r in repeats.remove_repeats(docs).collect()) == want
