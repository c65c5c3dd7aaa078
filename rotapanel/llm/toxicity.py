"""Toxicity classifier that doesn't react to which group a text names.

A logistic model on the distinct words of a text and their beginnings. Of every labelled text that holds
an identity term a counterfactual copy is made, in which each term is swapped for another one of its set, and the
fit pays for the squared change of the score between text and copy: neutral mentions of any group get like scores.
Sets of terms are an argument; the given ones are plain names of groups and pronouns of four languages.

At most ``SAMPLE`` labelled rows train (those of the smallest hashed ids; of documents with one id
the smallest text). Feature counts are summed in Spark; features whose log odds differ clearly between the classes are kept, at most
``FEATURES``. All texts are scored whole; a score costs one table look-up per feature.

Cases: null or empty texts get the score of the intercept; rows with null labels or
ids don't train; without labels all scores are 0.5, with one class the class's smoothed rate;
repeated rows are each scored; extra columns stay, ``score`` is replaced.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotapanel.llm import hashing
from rotapanel.llm.steps import written

SAMPLE, FEATURES = 10_000, 20_000
PREFIXES = [4, 5, 6, 40]  # bytes; the last is the whole word but for its very end
LEAST_Z, LEAST_TEXTS = 3.0, 3
L2, SWAP, STEPS = 2e-4, 1.0, 400
# Sets of terms that may be swapped for each other.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["muslims", "christians", "jews", "hindus", "atheists"], ["muslim", "christian", "jewish", "hindu"],
    ["gay", "straight", "lesbian"], ["black", "white", "asian", "latino"], ["immigrants", "refugees", "natives"],
    ["he", "she"], ["his", "her"], ["him", "her"],
    ["er", "sie"], ["sein", "ihr"], ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["il", "elle"], ["ils", "elles"], ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["él", "ella"], ["ellos", "ellas"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]

# Words are letters and bytes beyond ASCII, and digits.
_GAP = np.ones(256, bool)
_GAP[0x30:0x3A] = _GAP[0x61:0x7B] = _GAP[0x80:] = False
_FILTER_BITS = 22


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, and the text that each belongs to."""
    offsets = hashing.text_bytes(column)[1]
    found, owner = [], []
    for lo, part, at in hashing.word_starts(column, _GAP):
        text = np.searchsorted(offsets, at + lo, side="right") - 1
        for k, h in enumerate(hashing.prefix_hashes(part, at, _GAP, PREFIXES)):
            found.append(h + np.uint64(k))
            owner.append(text)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def _distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, owner))
    feature, owner = feature[order], owner[order]
    new = np.ones(len(feature), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    return feature[new], owner[new]


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def _sieve(self) -> np.ndarray:
        sieve = np.zeros(1 << _FILTER_BITS, bool)
        sieve[self.features >> np.uint64(64 - _FILTER_BITS)] = True
        return sieve

    def known(self, column: pa.Array, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the model's features in each text, without repeats."""
        feature, owner = text_features(column)
        maybe = sieve[feature >> np.uint64(64 - _FILTER_BITS)]
        feature, owner = feature[maybe], owner[maybe]
        if not len(self.features):
            return np.zeros(0, np.int64), owner[:0]
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        real = self.features[at] == feature
        return _distinct(at[real], owner[real])

    def scores(self, column: pa.Array, sieve: np.ndarray) -> np.ndarray:
        number, owner = self.known(column, sieve)
        z = self.intercept + np.bincount(owner, weights=self.weights[number], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def term_features(terms: list[str]) -> np.ndarray:
    return text_features(pa.array(terms, pa.string()))[0]


def swapper(sets: list[list[str]]):
    """A function that swaps every term of a text for another of its set, or gives None where there is none."""
    # A term of several sets belongs to the first.
    home = {t: own for own in reversed(sets) if len(own) > 1 for t in own}
    if not home:
        return lambda text: None
    edge = "[0-9A-Za-z\u0080-\U0010ffff]"
    words = "|".join(re.escape(t) for t in sorted(home, key=len, reverse=True))
    pattern = re.compile(f"(?<!{edge})(?:{words})(?!{edge})", re.IGNORECASE | re.ASCII)

    def swapped(text: str) -> str | None:
        turn = zlib.crc32(text.encode())

        def other(m: re.Match) -> str:
            term = m[0].lower()
            own = home.get(term) or home[m[0]]
            at = own.index(term if term in own else m[0])
            return own[(at + 1 + turn % (len(own) - 1)) % len(own)]

        out, n = pattern.subn(other, text)
        return out if n else None

    return swapped


def fit_logistic(
    rows: list[np.ndarray], labels: np.ndarray, size: int, copies: list[tuple[int, np.ndarray]] = (),
    l2: float = L2, swap: float = SWAP, steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of presence features, with the penalty on score changes.

    copies: (row, features of its counterfactual copy). The loss is the mean log loss, l2 / 2 times
    the squared weights, and swap times the squared score changes, summed over copies and divided by the rows.
    """
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    origin = np.array([k for k, _ in copies], np.int64)
    other = np.concatenate([c for _, c in copies]) if len(copies) else np.zeros(0, np.int64)
    other_owner = np.repeat(np.arange(len(copies)), [len(c) for _, c in copies])
    n = max(len(rows), 1)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    p = np.concatenate([np.zeros(size), [np.log(rate / (1 - rate))]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = p[-1] + np.bincount(owner, weights=p[index], minlength=len(rows))
        pull = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        error = pull.copy()
        g_copy = np.zeros(size + 1)
        if len(copies):
            change = 2 * swap / n * (z[origin] - p[-1] - np.bincount(other_owner, weights=p[other], minlength=len(copies)))
            np.add.at(error, origin, change)
            g_copy = np.bincount(other, weights=change[other_owner], minlength=size + 1)
        g = np.bincount(index, weights=error[owner], minlength=size + 1) - g_copy
        g[:size] += l2 * p[:size]
        g[-1] = pull.sum()  # the intercept is the same in a copy
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return p[:size], float(p[-1])


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, grade, sample: int) -> DataFrame:
    """(y, text) of at most ``sample`` labelled ids, stored: those of the smallest hash, each with its smallest text."""
    chosen = (
        labels.select(F.col(key).alias("k"), grade.alias("y")).where("k IS NOT NULL AND y IS NOT NULL").distinct()
        .orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    )
    # At most `sample` narrow rows are broadcast, and as many rows come out, however often an id repeats.
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "k")
    return written(rows.groupBy("k", "y").agg(F.min("text").alias("text")).select("y", "text"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    terms: list[list[str]] = IDENTITY_TERMS, sample: int = SAMPLE, swap: float = SWAP,
) -> ToxicityModel:
    """Fit on the texts of at most ``sample`` of the given labelled rows, and on their counterfactual copies.

    ``swap`` weighs the penalty on score changes between a text and its copy.
    """
    y = F.col(label).cast("int")
    rows = labelled_rows(docs, labels, key, text, F.when(y.isin(0, 1), y), sample)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                y = batch.column(0).to_numpy(zero_copy_only=False)
                feature, owner = _distinct(*text_features(batch.column(1)))
                kinds, at, n = np.unique(feature, return_inverse=True, return_counts=True)
                bad = np.bincount(at, weights=y[owner], minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n), pa.array(bad)], ["f", "n", "bad"])

    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    # Log odds ratio over its standard error.
    a, b = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    c, d = F.lit(toxic + 0.5) - F.col("bad"), F.lit(total - toxic + 0.5) - (F.col("n") - F.col("bad"))
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    clear = (
        rows.mapInArrow(counts, "f long, n long, bad long")
        .groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where(F.col("n") >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "f").limit(FEATURES).select("f").toArrow()["f"].to_numpy().view(np.uint64)
    )
    features = np.unique(np.concatenate([clear, term_features([t for own in terms for t in own])]))
    model = ToxicityModel(features, np.zeros(len(features)), 0.0)
    swapped = swapper(terms)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = model._sieve()

        def each(column: pa.Array) -> list[bytes]:
            number, owner = model.known(column, sieve)
            cut = np.searchsorted(owner, np.arange(len(column) + 1))
            return [number[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(cut, cut[1:])]

        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                copies = [swapped(t) for t in batch.column(1).to_pylist()]
                other = [x if c is not None else None for c, x in zip(copies, each(pa.array([c or "" for c in copies], pa.string())))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(each(batch.column(1)), pa.binary()), pa.array(other, pa.binary())], ["y", "i", "other"]
                )

    def numbered(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.int32).astype(np.int64)

    got = rows.mapInArrow(numbers, "y int, i binary, other binary").toArrow()
    sets = [numbered(x) for x in got["i"].to_pylist()]
    copies = [(k, numbered(x)) for k, x in enumerate(got["other"].to_pylist()) if x is not None]
    weights, intercept = fit_logistic(sets, got["y"].to_numpy().astype(float), len(features), copies, swap=swap)
    return ToxicityModel(features, weights, intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the score, 0 to 1, of every whole text."""
    columns = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = model._sieve()
        for whole in batches:
            for batch in hashing.slices(whole, text):
                scores = model.scores(batch.column(columns.index(text)), sieve)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*columns, column])

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).schema.add(column, "double"))
