import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotapanel.llm import centroids


def by_hand(rows, k, rounds, dims):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    at = [v for _, v in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in good)[:k]]

    def choose():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in good]

    for _ in range(rounds):
        own = choose()
        for j in range(len(at)):
            mine = [v for (_, v), (_, at_j) in zip(good, own) if at_j == j]
            if mine:
                at[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = choose()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    per = [sum(d for d, j in own if j == c) for c in range(len(at))]
    return sorted(((i, j, d, per[j], sum(per), shas[j]) for (i, _), (d, j) in zip(good, own)), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in centroids.cluster_table(df.withColumn("cluster", F.lit("x")), **options).collect()), key=str)


@pytest.mark.parametrize("seed, n, k, dims, spread", [(1, 400, 8, 6, 1.0), (2, 300, 20, 3, 0.01), (3, 150, 1, 4, 1.0), (4, 200, 12, 2, 0.004)])
def test_equals_plain_search(spark, monkeypatch, seed, n, k, dims, spread):
    monkeypatch.setattr(centroids, "BLOCK", 32)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, dims))
    rows = [(int(i), (spread * (centre[rng.integers(7)] + 0.3 * rng.normal(size=dims))).tolist()) for i in range(n)]
    assert found(spark, rows, k=k, dims=dims) == by_hand(rows, k, 10, dims)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(16, 8)) * 3
    rows = [(i, (centre[i % 16] + 0.2 * rng.normal(size=8)).tolist()) for i in range(4_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, at, work = centroids.cluster_vectors(df, k=16, dims=8)
    # Plain search takes 16 distances a vector; the first round knows nothing yet.
    assert len(at) == 16 and work[0] > 4_000 and all(w < 16 * 4_000 / 2 for w in work[1:]) and min(work) < 4_000


def test_search_is_exact_under_any_moves():
    rng = np.random.default_rng(6)
    x, at, before, state = rng.integers(-40, 40, (500, 3)).astype(np.int32), rng.integers(-40, 40, (30, 3)), None, None
    for _ in range(15):
        state, _ = centroids.search(x, centroids.Centroids(at, before), state)
        far = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (state[0] == far.argmin(1)).all()
        assert (np.sqrt(far[np.arange(500), state[0]]) <= state[2]).all()
        others = far.copy()
        others[np.arange(500), state[0]] = 1 << 60
        assert (np.sqrt(others.min(1)) >= state[3]).all()
        before, at = at, at + rng.integers(-3, 4, at.shape) * (rng.random((30, 1)) < 0.5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.0]), (1, [0.5, -0.0]), (2, [0.5, 0.5]), (None, [-0.3, 0.1]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-7.0004, 1e-9]), (1, [9.0, 9.0]),
    ]
    for k in (1, 3, 20):
        assert found(spark, rows, k=k, dims=2) == by_hand(rows, k, 10, 2)
    assert found(spark, rows[4:6], dims=2) == []
    assert found(spark, [(1, [float(centroids.LIMIT), 0.0])], dims=2) == []


def test_a_round_joins_without_a_shuffle(spark):
    df = spark.range(5_000).select(F.col("id"), F.array(F.rand(1), F.rand(2)).alias("vector"))
    name, blocks = centroids.bucketed(centroids.pack(df, 2), ["block"], 4)
    c = centroids.Centroids(np.array([[0, 0], [9, 9]]), None)
    other, state = centroids.bucketed(centroids.move_on(blocks, None, c), ["block"], 4, dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = centroids.move_on(blocks, state, c)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for table in (name, other):
        centroids.drop_table(spark, table)
