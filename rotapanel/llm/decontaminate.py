"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` words the smallest hash of its ``GRAM``-word grams is a
fingerprint of the text (the leftmost of equal ones). Two texts that share a
window share its fingerprint, so a join of fingerprints finds every shared window.
A match is extended on both sides, word by word, to the windows around it that
are equal in both texts. Items with fewer words than a window are one window of
their own length and are looked up at every word.

Only columns and SQL functions are used. Fingerprints of the benchmark are
broadcast if their counted number is within ``BROADCAST_GRAMS``, else joined by shuffle.
Documents are read once: a marker row per document goes along with the matches.

Cases: null or empty texts have no words and no hits, and null or empty items occur
nowhere; rows are told apart by id and text, repeated rows each come back; null ids
are kept; an empty table gives an empty result, an empty benchmark no hits; equal
items count as several; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.llm.url_filter import LOWER, UPPER
from rotapanel.session import join_small, settle

WINDOW, GRAM = 10, 5
BROADCAST_GRAMS = 500_000
_PLACE = 30  # bits of a packed fingerprint that hold the word's place
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates a column once for several uses within one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text, with A to Z lower-cased; null gives none."""
    lower = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), _NOT_WORD), "")


def _hashes(text_words: Column) -> Column:
    return F.transform(text_words, lambda w: F.xxhash64(w))


def _packed(hashes: Column, length: int, kind: int) -> Column:
    """Of each gram: 33 bits of its hash, then its place. The text must have ``length`` words."""
    def one(i: Column) -> Column:
        h = F.xxhash64(*[F.get(hashes, i + k) for k in range(length)], F.lit(kind))
        return F.shiftleft(F.shiftrightunsigned(h, 31), _PLACE) + i

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - length), one)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def fingerprints(text_words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Packed fingerprints of a text of at least a window."""
    reach = window - gram + 1

    def winnow(grams: Column) -> Column:
        least = F.transform(
            F.sequence(F.lit(0), F.size(grams) - reach), lambda i: F.least(*[F.get(grams, i + k) for k in range(reach)])
        )
        return F.array_distinct(least)

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) < window, _none()).otherwise(let(_packed(hashes, gram, 0), winnow))

    return let(_hashes(text_words), of)


def _short_grams(text_words: Column, length: int) -> Column:
    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) < length, _none()).otherwise(_packed(hashes, length, length))

    return let(_hashes(text_words), of)


def _around(text_words: Column, place: Column, window: int, gram: int) -> Column:
    """The words that windows around a gram can hold; the gram's place in them is min(place, window - gram)."""
    left = F.least(place, F.lit(window - gram))
    return F.slice(text_words, place - left + 1, left + window)


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE)


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Per document: key, text_hash, n_words, n_hit, n_items, items (sorted ids as text), spans.

    spans are the windows found, as (start, length) in words.
    """
    own = items.select(F.col(item_key).cast("string").alias("item"), words(F.col(item_text)).alias("iw")).where("size(iw) > 0")
    own = settle(own)
    # At most window - 1 lengths.
    short = [r[0] for r in own.where(F.size("iw") < window).select(F.size("iw")).distinct().collect()]
    long_rows = (
        own.where(F.size("iw") >= window)
        .select("item", "iw", F.explode(fingerprints(F.col("iw"), window, gram)).alias("fp"))
        .select(
            _hash_of(F.col("fp")).alias("h"), "item", F.lit(0).alias("kind"), _place_of(F.col("fp")).alias("q"),
            _around(F.col("iw"), _place_of(F.col("fp")), window, gram).alias("ictx"),
        )
    )
    short_rows = [
        own.where(F.size("iw") == m).select(
            _hash_of(F.element_at(_short_grams(F.col("iw"), m), 1)).alias("h"), "item", F.lit(m).alias("kind"),
            F.lit(0).alias("q"), F.col("iw").alias("ictx"),
        )
        for m in short
    ]
    grams = settle(reduce(DataFrame.unionByName, short_rows, long_rows))
    few = grams.count() <= BROADCAST_GRAMS

    def entries(w: Column) -> Column:
        return F.concat(F.array(F.lit(-1).cast("bigint")), fingerprints(w, window, gram), *[_short_grams(w, m) for m in short])

    # The words around a fingerprint are cut out before it becomes a row: a row must not hold its whole text.
    def entry(w: Column, fp: Column) -> Column:
        p = _place_of(fp)
        return F.struct(_hash_of(fp).alias("h"), p.alias("p"), F.when(fp >= 0, _around(w, p, window, gram)).alias("ctx"))

    rows = (
        docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("w"))
        .select(
            "doc", "text_hash", F.size("w").cast("bigint").alias("n_words"),
            F.explode(let(F.col("w"), lambda w: F.transform(entries(w), lambda fp: entry(w, fp)))).alias("e"),
        )
        .select("doc", "text_hash", "n_words", "e.h", "e.p", "e.ctx")
    )
    if few:
        met = rows.join(F.broadcast(grams), "h", "left").where("h = -1 OR item IS NOT NULL")
    else:
        met = rows.where("h >= 0").join(grams, "h").unionByName(rows.where("h = -1"), allowMissingColumns=True)
    # Extension: the windows that start s words before the gram and are equal in both texts.
    left = F.least(F.col("p"), F.lit(window - gram))
    item_left = F.least(F.col("q"), F.lit(window - gram))

    def equal(s: Column) -> Column:
        mine = F.slice("ctx", left - s + 1, window)
        theirs = F.slice("ictx", item_left - s + 1, window)
        return (s <= F.least(left, item_left)) & (F.size(mine) == window) & (mine == theirs)

    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(window - gram)), equal),
        lambda s: F.struct((F.col("p") - s).alias("start"), F.lit(window).alias("length")),
    )
    whole = F.when(
        F.slice("ctx", left + 1, F.greatest("kind", F.lit(1))) == F.col("ictx"),
        F.array(F.struct(F.col("p").alias("start"), F.col("kind").alias("length"))),
    )
    found = F.when(F.col("kind") == 0, starts).when(F.col("kind") > 0, whole)
    met = met.withColumn("found", F.when(F.col("h") >= 0, found)).where("h = -1 OR size(found) > 0")
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_set("found"))))
    hit = F.size("found") > 0
    per = met.groupBy("doc", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("h") == -1, 1).otherwise(0)).alias("copies"),
        spans.alias("spans"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item")))).alias("items"),
    )

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
        )

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda acc: acc["n"])
    return per.select(
        F.col("doc").alias(key), "text_hash", "n_words", covered.cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), "items", "spans",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without any hit, with all their columns."""
    marked = docs.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_text": F.xxhash64(F.col(text))})
    bad = (
        find_hits(docs, items, key, text).where("n_hit > 0")
        .select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col("text_hash").alias("_text")).distinct()
    )
    return join_small(marked, bad, ["_key", "_text"], "left_anti").select(*docs.columns)
