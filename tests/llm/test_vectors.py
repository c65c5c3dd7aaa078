import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.llm import vectors


def by_hand(rows, least=0.98):
    good = [
        (i, lab, np.array(v, float), at) for at, (i, v, lab) in enumerate(rows)
        if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
    ]
    root, links = {i: i for i, _, _ in rows if i is not None}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x, u, a) in enumerate(good):
        for j, y, v, b in good[:k]:
            if x == y and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= least:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, links.get(at, 0), find(i), find(i) == i) for at, (i, _, _) in enumerate(rows) if i is not None)


def found(spark, rows, near=vectors.NEAR):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clashing = df.withColumns({c: F.lit("own") for c in ("cid", "size", "place", "comp", "n_links")})
    return sorted(tuple(r) for r in vectors.group_vectors(clashing, near=near).collect() if r.vec_id is not None)


def clusters(seed, sizes, dims=16, noise=0.05):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        centre = rng.normal(size=dims)
        for _ in range(size):
            v = centre + rng.normal(size=dims) * noise * rng.integers(0, 4)
            rows.append(((v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(size % 3)))
    order = rng.permutation(len(rows))
    return [(int(k), *rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed, sizes", [(1, [1] * 150 + [2, 3, 5, 8] * 12), (2, [300, 40, 1, 1, 1])])
def test_equals_all_pairs(spark, monkeypatch, seed, sizes):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "CHUNK", 80)
    rows = clusters(seed, sizes)
    got, want = found(spark, rows, 16), by_hand(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    missed = sum(max(0, w[1] - g[1]) for g, w in zip(got, want))
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and missed <= 0.01 * sum(w[1] for w in want)


def test_passes_follow_from_the_count():
    assert vectors.passes(2) == 1 or vectors.passes(2) < vectors.passes(10**6) < vectors.passes(10**9)
    for count in (10**3, 10**6, 10**9):
        agree = (1 - np.arccos(0.98) / np.pi) ** (np.log2(count / vectors.NEAR) + 1)
        assert (1 - agree) ** vectors.passes(count) <= vectors.MISS


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [5.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0),
        (8, [1.0, nan], 0), (9, [1.0, inf], 0), (10, [1.0, None], 0), (11, [1.0, 0.0], None), (12, [1.0, 0.0, 0.0], 0), (13, [-0.0, 1.0], 0),
        (14, [0.0, 1.0], 0), (15, [3e38, 3e38], 0), (16, [1e-30, 1e-30], 0), (None, [1.0, 0.0], 0),
    ]
    got = found(spark, rows)
    assert got == by_hand(rows)
    df = spark.createDataFrame(rows[-1:], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vectors.group_vectors(df).collect()] == [(None, 0, None, True)]
    assert vectors.group_vectors(df.where("label = 9")).count() == 0


def planted(seed, count, pairs, mutual, dims=64):
    """Vectors around one direction, with a given mutual cosine, of which the last ``pairs`` have a partner at cosine 0.981."""
    rng = np.random.default_rng(seed)

    def units(n, *others):
        x = rng.normal(size=(n, dims))
        for y in others:
            x -= (x * y).sum(1, keepdims=True) / (y * y).sum(1, keepdims=True) * y
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    centre = units(1)
    x = np.sqrt(mutual) * centre + np.sqrt(1 - mutual) * units(count, centre)
    x = np.vstack([x, 0.981 * x[-pairs:] + np.sqrt(1 - 0.981**2) * units(pairs, x[-pairs:])])
    return [(k, v, 0) for k, v in enumerate(x.astype(np.float32).tolist())]


def lost(spark, rows, count, pairs):
    """Planted pairs in different components."""
    component = {r[0]: r[2] for r in found(spark, rows)}
    return sum(component[count - pairs + k] != component[count + k] for k in range(pairs))


def test_no_pair_is_lost_in_a_dense_label(spark):
    """Signs part such vectors badly: the sample shows it, and windows grow until nothing is missing."""
    assert lost(spark, planted(3, 6000, 300, 0.93), 6000, 300) <= 3


def test_spread_vectors_of_a_label_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 3_000)
    assert lost(spark, planted(4, 12_000, 300, 0.0), 12_000, 300) <= 1


def test_windows_are_bounded(spark):
    """Sorted vectors meet the next ones of their window only; a wide window meets all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x = x[np.argsort(x[:, 0])] / np.linalg.norm(x[np.argsort(x[:, 0])], axis=1, keepdims=True)
    for width in (5, 400):
        root = list(range(300))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for i, j in vectors.neighbour_links(x, width, 0.9):
            assert 0 < j - i <= width and x[i] @ x[j] >= 0.9 and find(i) != find(j)
            root[find(j)] = find(i)
        for i in range(300):
            for j in range(i + 1, min(300, i + width + 1)):
                assert x[i] @ x[j] < 0.9 or find(i) == find(j)


def test_labels_of_any_type_and_double_precision(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 1e-9], "x"), (3, [1.0, 0.0], "y"), (4, [1.0, 0.0], ""), (5, [1e200, 1e200], "z"), (6, [2e200, 2e200], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.group_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
