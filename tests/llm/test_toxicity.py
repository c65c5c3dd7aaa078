import numpy as np
import pytest

from rotapanel.llm import catalog, toxicity


def test_held_out_accuracy(spark, sf):
    scores = catalog.QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    own = scores[scores.held_out]
    a, b = own[own.toxic == 1].score.to_numpy(), own[own.toxic == 0].score.to_numpy()
    assert np.mean(a[:, None] > b[None, :]) > 0.75
    assert ((own.score >= 0.3) == own.predicted).all()
    train = scores[~scores.held_out]
    assert ((train.predicted == 1) == (train.toxic == 1)).mean() > 0.9


@pytest.fixture(scope="module")
def mentions(spark):
    """Texts in which one group is named together with abuse far more often than another."""
    rng, rows = np.random.default_rng(2), []
    for k in range(600):
        words = [f"word{x}" for x in rng.integers(0, 60, 12)]
        toxic = int(rng.random() < 0.4)
        if toxic:
            words[3] = ["vile", "scummy"][k % 2] if rng.random() < 0.8 else words[3]
        if rng.random() < (0.7 if toxic else 0.1):
            words[7] = "muslims"
        elif rng.random() < 0.3:
            words[7] = "christians"
        rows.append((k, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swapped_terms_get_like_scores(spark, mentions, monkeypatch):
    pairs = ["nice {} live here", "the {} of this town", "{}"]
    texts = spark.createDataFrame([(p.format(t), t, k) for k, p in enumerate(pairs) for t in ("muslims", "christians")], "text string, t string, k int")

    def gap(model):
        rows = toxicity.score_toxicity(texts, model).toPandas().pivot(index="k", columns="t", values="score")
        return float((rows["muslims"] - rows["christians"]).abs().max()), float(rows["muslims"].max())

    fair = toxicity.fit_toxicity(mentions, mentions)
    plain = toxicity.fit_toxicity(mentions, mentions, terms=[["zebras", "yaks"]])
    (gap_fair, top_fair), (gap_plain, top_plain) = gap(fair), gap(plain)
    assert gap_fair < 0.3 * gap_plain and top_fair < top_plain
    scored = toxicity.score_toxicity(mentions, fair).toPandas()
    assert scored[scored.text.str.contains("vile|scummy")].score.min() > 0.5


def dense(rows, size):
    x = np.zeros((len(rows), size + 1))
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r] = 1
    return x


def loss(p, x, y, gaps, l2, swap):
    z = x @ p
    return np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * (p[:-1] ** 2).sum() + swap * ((gaps @ p) ** 2).sum() / len(x)


def newton(x, y, gaps, l2, swap):
    """Optimum of the penalised loss by full Newton steps."""
    p, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ p))
        g = x.T @ (q - y) / len(x) + ridge @ p + 2 * swap / len(x) * gaps.T @ (gaps @ p)
        h = x.T @ (x * (q * (1 - q))[:, None]) / len(x) + ridge + 2 * swap / len(x) * gaps.T @ gaps
        p = p - np.linalg.solve(h, g)
    return p


@pytest.mark.parametrize("swap", [0.0, 1.0, 25.0])
def test_fit_equals_a_dense_fit(swap):
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(9) < 0.4) for _ in range(200)]
    y = (rng.random(200) < [0.2 + 0.6 * (0 in r) * (3 not in r) for r in rows]).astype(float)
    # Feature 0 is a term that copies swap for feature 1, and 2 for 3.
    copies = [(k, np.unique([{0: 1, 2: 3}.get(i, i) for i in r])) for k, r in enumerate(rows) if 0 in r or 2 in r]
    gaps = dense(rows, 9)[[k for k, _ in copies]] - dense([c for _, c in copies], 9)
    weights, intercept = toxicity.fit_logistic(rows, y, 9, copies, l2=1e-3, swap=swap, steps=3_000)
    best = newton(dense(rows, 9), y, gaps, 1e-3, swap)
    got = np.append(weights, intercept)
    assert loss(got, dense(rows, 9), y, gaps, 1e-3, swap) - loss(best, dense(rows, 9), y, gaps, 1e-3, swap) < 1e-7
    assert np.abs(got - best).max() < 0.02
    short, _ = toxicity.fit_logistic(rows, y, 9, copies, l2=1e-3, swap=swap)
    assert np.abs(short - weights).max() < 0.2


def test_copies_swap_whole_words_of_a_set():
    swap = toxicity.swapper([["muslims", "jews", "hindus"], ["he", "she"], ["alone"]])
    assert swap("the alone theme, cheers") is None and swap("") is None
    assert swap("He said: she.") == "she said: he."
    out = {swap(f"{k} Muslims") for k in range(20)}
    assert {x.split()[1] for x in out} == {"jews", "hindus"}
    assert toxicity.swapper([]) ("he") is None
    for own in toxicity.IDENTITY_TERMS:
        assert toxicity.swapper(toxicity.IDENTITY_TERMS)(own[0]) != own[0]


def test_the_penalty_acts_on_the_given_documents(spark, sf):
    """The corpus holds pronouns: scores of the query's own fit change when the penalty is taken out."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    with_, without = (toxicity.fit_toxicity(docs, labels, swap=s) for s in (toxicity.SWAP, 0.0))
    assert (with_.features == without.features).all() and np.abs(with_.weights - without.weights).max() > 1e-3


def test_rows_that_train_are_bounded(spark):
    docs = spark.range(3_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_rows(docs, labels, "doc_id", "text", labels.toxic, 8).collect()
    assert sorted((r.y, r.text) for r in rows) == [(0, "text 0"), (1, "text 0")]


def test_odd_rows(odd, no_rows, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (2, None), (6, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == odd.count() and got.where("NOT (score BETWEEN 0 AND 1)").isEmpty()
    assert got.where("text IS NULL OR text = ''").select("score").distinct().count() == 1
    assert toxicity.score_toxicity(no_rows, model).count() == 0
    blank = toxicity.fit_toxicity(odd, labels.where("doc_id < 0"))
    assert [r.score for r in toxicity.score_toxicity(odd, blank).select("score").distinct().collect()] == [0.5]
