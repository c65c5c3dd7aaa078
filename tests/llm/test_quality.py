import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rotapanel.llm import quality


def test_thresholds_are_ordered_and_grades_are_learned():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = [(np.array([5, 9], np.int32), np.array([g / 3 + rng.normal(0, 0.05), 0.5], np.float32)) for g in grades]
    model = quality.fit_ordinal(rows, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([sum(model.weights[i] * v) for i, v in rows])
    tails = model.tails(score)
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95


def test_scores_follow_from_the_features():
    texts = ["One two two 3!", "", None, "AAA!! bb%%% é\nx", "a " * 1000]
    weights = np.random.default_rng(1).normal(size=quality.SIZE).astype(np.float32)
    direct = [float((weights[i] * v).sum()) for i, v in quality.sparse_features(pa.array(texts))]
    assert np.allclose(quality.linear_scores(pa.array(texts), weights), direct, atol=1e-4)


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = quality.fit_quality(docs, train, quality.label_grade())
    rows = quality.score_quality(docs, model).join(test, "doc_id").select("p_tail", "quality", "expected_grade").toPandas()
    assert ((rows.p_tail >= 0.5) == (rows.quality == 1)).mean() > 0.97
    assert rows[rows.quality == 1].expected_grade.mean() > rows[rows.quality == 0].expected_grade.mean() + 1


def test_odd_rows(odd, no_rows, spark, sf):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(odd, labels, quality.label_grade())
    got = quality.score_quality(odd.withColumn("grade", F.lit("own")), model)
    assert got.count() == odd.count() and got.where("NOT (p_tail BETWEEN 0 AND 1) OR NOT (expected_grade BETWEEN 0 AND 2)").isEmpty()
    empty = got.where("text IS NULL OR trim(text) = ''").select("p_tail").distinct().collect()
    assert len(empty) <= 2  # no features, or blanks only
    assert quality.score_quality(no_rows, model).count() == 0
    none = quality.fit_quality(odd, labels.where("doc_id < 0"), quality.label_grade())
    assert np.allclose(quality.score_quality(odd, none).select("expected_grade").toPandas(), 1.0)


def test_fit_is_the_optimum_of_a_small_dense_problem(monkeypatch):
    """No small move of any weight or threshold lowers the penalised loss, which is that of a plain gradient descent."""
    monkeypatch.setattr(quality, "SIZE", 4)
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (300, 4))
    grades = np.digitize(x @ [3, -2, 1, 0] + rng.logistic(size=300) / 2, [0.3, 1.5])
    rows = [(np.arange(4, dtype=np.int32), r.astype(np.float32)) for r in x]
    model = quality.fit_ordinal(rows, grades, 3, l2=1e-2, steps=3_000)

    def loss(w, theta):
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        z = x @ w
        p = 1 / (1 + np.exp(z - edge[grades + 1])) - 1 / (1 + np.exp(z - edge[grades]))
        return -np.log(np.maximum(p, 1e-300)).mean() + 0.5e-2 * (w**2).sum()

    w, theta = model.weights.astype(float), model.thresholds.copy()
    best = loss(w, theta)
    for k in range(4):
        for d in (-0.02, 0.02):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, theta) > best
    for k in range(2):
        for d in (-0.02, 0.02):
            moved = theta.copy()
            moved[k] += d
            assert loss(w, moved) > best
    v, t = np.zeros(4), np.array([0.0, 1.0])
    for _ in range(4_000):
        g = [(loss(v + e, t) - loss(v - e, t)) / 2e-5 for e in np.eye(4) * 1e-5] + [(loss(v, t + e) - loss(v, t - e)) / 2e-5 for e in np.eye(2) * 1e-5]
        v, t = v - np.array(g[:4]), t - np.array(g[4:])
    assert abs(loss(v, t) - best) < 1e-5 and np.abs(v - w).max() < 0.02
