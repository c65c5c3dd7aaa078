"""Quality classifier: ordinal regression with cumulative links on hashed text.

``P(grade <= k) = sigmoid(threshold_k - weights . x)`` with one weight vector for all
grades and ordered thresholds. x holds shares: of hashed words, of hashed triples of
character runs (letters, digits, each mark; with their lengths), and of words that repeat
the word one or two before. A text's score needs one look-up per word and run.

The fit takes at most ``SAMPLE`` labelled rows (those of the smallest hashed ids); all
texts are scored whole. Only the sample's sparse features reach the driver.

The labels grade 0 (junk), 1 (readable but toxic) and 2 (clean). Selection is by the
tail probability of grade 1.

Cases: null or empty texts have no features, so their score is that of the thresholds alone;
rows with null labels or ids don't train; without any labelled row, or with one
grade only, every grade counts as equally likely; repeated rows are each scored; extra columns stay,
``expected_grade``, ``p_tail`` and ``grade`` are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.llm import hashing
from rotapanel.llm.toxicity import labelled_rows

SAMPLE = 8_000
WORD_BITS, SHAPE_BITS = 14, 12
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 2
ADDED = ["expected_grade", "p_tail", "grade"]
TAIL, LEAST = 1, 0.5
L2, STEPS, RATE = 1e-5, 250, 1.0

# Kinds of bytes: space, line end, lower, upper, digit, beyond ASCII; every mark is its own kind.
_KIND = np.arange(256, dtype=np.int64) + 10
_KIND[[0x20, 0x09, 0x0B, 0x0C]] = 0
_KIND[[0x0A, 0x0D]] = 1
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 2, 3, 4, 5


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed triples of runs of one kind of byte, and offsets of texts in them."""
    raw, offsets = hashing.text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(new)
    length = np.minimum(np.diff(at, append=len(raw)), 3)
    token = (kind[at] * 4 + np.where(kind[at] == 2, 1, length)).astype(np.uint64)
    with np.errstate(over="ignore"):
        after, third = np.append(token[1:], np.uint64(0)), np.append(token[2:], [np.uint64(0)] * min(2, len(token)))
        triple = hashing.mix(token + after * np.uint64(1_000_003) + third[: len(token)] * np.uint64(998_244_353_001))
    return (triple >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), np.searchsorted(at, offsets)


def _parts(column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Feature numbers and offsets: words, runs, repeats of the last word, of the one before."""
    words, off = hashing.word_hashes(column)
    index = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    runs, run_off = _runs(column)
    same = []
    for back in (1, 2):
        hit = np.zeros(len(words), np.int64)
        hit[back:] = words[back:] == words[:-back]
        same.append(hit)
    return (index, off), (runs + (1 << WORD_BITS), run_off), (same[0], off), (same[1], off)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def linear_scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """weights . x of each text."""
    (words, off), (runs, run_off), (one, _), (two, _) = _parts(column)
    n, r = np.maximum(np.diff(off), 1), np.maximum(np.diff(run_off), 1)
    return (
        _sums(weights[words], off) / n + _sums(weights[runs], run_off) / r
        + weights[SIZE - 2] * _sums(one, off) / n + weights[SIZE - 1] * _sums(two, off) / n
    )


def sparse_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and shares of each text."""
    (words, off), (runs, run_off), (one, _), (two, _) = _parts(column)
    out = []
    for k in range(len(off) - 1):
        a, na = np.unique(words[off[k] : off[k + 1]], return_counts=True)
        b, nb = np.unique(runs[run_off[k] : run_off[k + 1]], return_counts=True)
        n = max(off[k + 1] - off[k], 1)
        again = [one[off[k] : off[k + 1]].sum() / n, two[off[k] : off[k + 1]].sum() / n]
        out.append((
            np.concatenate([a, b, [SIZE - 2, SIZE - 1]]).astype(np.int32),
            np.concatenate([na / n, nb / max(run_off[k + 1] - run_off[k], 1), again]).astype(np.float32),
        ))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, count: int, l2: float = L2, steps: int = STEPS
) -> OrdinalModel:
    """Maximum penalised likelihood by full gradients with adaptive steps.

    Thresholds are the first one plus exponentials, so they stay ordered.
    """
    if not len(rows) or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(SIZE, np.float32), np.log(np.arange(1, count) / np.arange(count - 1, 0, -1)))
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    off = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
    owner = np.repeat(np.arange(len(rows)), np.diff(off))
    share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + count) for k in range(count - 1)])
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(SIZE), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, theta = p[:SIZE], np.cumsum(np.concatenate([p[SIZE : SIZE + 1], np.exp(p[SIZE + 1 :])]))
        score = np.add.reduceat(w[index] * value, off[:-1])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sigmoid(edge[grades + 1] - score), _sigmoid(edge[grades] - score)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_w = np.bincount(index, weights=value * ((d_hi - d_lo) / len(rows))[owner], minlength=SIZE) + l2 * w
        g_theta = np.array([-(d_hi[grades == k].sum() - d_lo[grades == k + 1].sum()) / len(rows) for k in range(count - 1)])
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, later[:1], later[1:] * np.exp(p[SIZE + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * (1 - t / (steps + 1))
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    theta = np.cumsum(np.concatenate([p[SIZE : SIZE + 1], np.exp(p[SIZE + 1 :])]))
    return OrdinalModel(p[:SIZE].astype(np.float32), theta)


def label_grade() -> Column:
    """Grade of a row of ``labels``."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)


def fit_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, count: int = 3, key: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> OrdinalModel:
    """Fit on the texts of at most ``sample`` labelled rows; of documents with one id the smallest text trains."""
    rows = labelled_rows(docs, labels, key, text, grade.cast("int"), sample).withColumnRenamed("y", "grade")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                got = sparse_features(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
                    ["grade", "i", "v"],
                )

    got = rows.mapInArrow(features, "grade int, i binary, v binary").toArrow()
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist())]
    return fit_ordinal(pairs, got["grade"].to_numpy().astype(np.int64), count)


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text", tail: int = TAIL) -> DataFrame:
    """Adds expected_grade, p_tail = P(grade >= tail) and the likeliest grade."""
    columns = [c for c in docs.columns if c not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, text):
                tails = model.tails(linear_scores(batch.column(columns.index(text)), model.weights))
                each = -np.diff(np.hstack([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, tail - 1]), pa.array(each.argmax(1).astype(np.int32))],
                    [*columns, *ADDED],
                )

    schema = docs.select(*columns).schema.add("expected_grade", "double").add("p_tail", "double").add("grade", "integer")
    return docs.select(*columns).mapInArrow(run, schema)


def select_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose tail probability is at least ``least``, with their columns."""
    model = fit_quality(docs, labels, label_grade(), key=key, text=text)
    return score_quality(docs, model, text).where(F.col("p_tail") >= least).drop(*ADDED).select(*docs.columns)
