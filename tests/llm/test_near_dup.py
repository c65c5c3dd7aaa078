import numpy as np
import pytest

from rotapanel.llm import hashing, near_dup
from rotapanel.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def by_hand(rows, percent=85):
    """Components of documents by comparing all pairs."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_dup.group_documents(df, percent=85).collect())


def variants(rng, groups, copies, length=60, most=5):
    """Copies of texts with some words changed, so that similarities spread around the threshold."""
    rows = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, length)]
        for _ in range(copies):
            text = list(base)
            for at in rng.integers(0, length, rng.integers(0, most)):
                text[at] = f"v{rng.integers(0, 9999)}"
            rows.append(" ".join(text))
    order = rng.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed, groups, copies", [(1, 40, 4), (2, 2, 90)])
def test_equals_all_pairs(spark, monkeypatch, seed, groups, copies):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # many blocks in the large groups
    rows = variants(np.random.default_rng(seed), groups, copies)
    assert found(spark, rows) == by_hand(rows)


def test_threshold_is_met_exactly(spark):
    # 20 shingles each; a common run of 19 words gives 15, of 23 words 19 of 21
    a = [f"a{k}" for k in range(24)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:23] + ["z"])), (3, " ".join(a[:20] + ["y"] * 4))]
    assert found(spark, rows) == by_hand(rows)
    # 17 of 20: exactly 85 %
    b = [f"b{k}" for k in range(24)]
    assert found(spark, [(1, " ".join(b)), (2, " ".join(b[:21]))]) == [(1, 20, 1, True), (2, 17, 1, False)]


def test_odd_rows(odd, no_rows, spark):
    got = sorted((tuple(r) for r in near_dup.group_documents(odd, percent=85).collect()), key=str)
    known = {r[0]: r[1:] for r in got if r[0] is not None}
    assert known[1] == (7, 1, True) and known[2] == (7, 1, False) and sum(r[0] == 2 for r in got) == 2
    assert known[3] == (0, 3, True) and known[4] == (0, 4, True) and known[5] == (0, 5, True) and known[6] == (1, 6, True)
    assert known[7] == (5, 7, True)  # a long text of five words again and again
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None, True), (7, None, True)]
    assert near_dup.group_documents(no_rows).count() == 0
    left = near_dup.remove_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8]
    again = spark.createDataFrame([(9, "a b c d e f")] * 3 + [(10, "g h")], "doc_id long, text string")
    assert near_dup.remove_near_duplicates(again).count() == 2


def test_components_equal_a_search(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_words_over_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["Aa bB\tcc  dd", None, "", "x" * 50 + " y z", "one two three four five six " * 20, "É é É"]
    whole = [s.tolist() for s in hashing.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(hashing, "CHUNK", 16)
    assert [s.tolist() for s in hashing.shingle_sets(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    words, off = hashing.word_hashes(pa.array(["aa BB", "bb aA"]))
    assert words[:2].tolist() == words[2:][::-1].tolist() and off.tolist() == [0, 2, 4]


def test_texts_of_one_id_stand_for_themselves(spark):
    rng = np.random.default_rng(6)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(6)]
    a, b, c, d, e, f = own
    near = a.rsplit(" ", 1)[0] + " z"  # 35 of 37 shingles in common with a
    rows = [(1, a), (2, b), (5, near), (5, c), (5, d), (5, ""), (7, e), (7, e), (7, b), (7, e.upper()), (8, f), (5, a), (None, a)]
    # Rows of an id are one node: 1 with 5, and 2 with 7.
    want = [(1, 1), (2, 2), (5, 1), (5, 1), (5, 1), (5, 1), (5, 1), (7, 2), (7, 2), (7, 2), (7, 2), (8, 8)]
    got = [r for r in found_with_null(spark, rows) if r[0] is not None]
    assert sorted((r[0], r[2]) for r in got) == want and all(r[3] == (r[0] == r[2]) for r in got)
    left = near_dup.remove_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in left.collect()]
    # one row of every text that isn't near another, whatever else its id holds; e and its capitals are one set
    kept_e = [t for t in texts if t[1].lower() == e]
    assert len(kept_e) == 1 and kept_e[0][0] == 7
    assert sorted((t for t in texts if t not in kept_e and t[0]), key=str) == sorted([(1, a), (2, b), (5, c), (5, d), (5, ""), (8, f)], key=str)
    assert [t for t in texts if t[0] is None] == [(None, a)]


def found_with_null(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in near_dup.group_documents(df, percent=85).collect()]
