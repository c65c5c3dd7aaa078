"""Exact removal of repeated byte strings, by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``WINDOW`` bytes that starts anywhere else too, in
any text. Candidates come from anchors (see ``anchors``): windows can be equal only if they share
an anchor, at the same distance. Around an anchor that occurs more than once, the bytes
of each run of windows form a segment; equal segments count as one with their number.

Segments of one anchor with differing bytes are resolved in buckets. There the
segments, with the anchor as one symbol, are dealt to shards; each shard's suffixes are sorted once into
a Burrows-Wheeler transform. The merge refines the interleave of the shards' suffixes, step by
step: in round h the interleave is ordered by the first h symbols, and moving every suffix to the one before
it (by the transform) and sorting stably by that symbol gives round h + 1. Boundaries that
appear in round h mark common prefixes of h symbols. Only the suffixes that lead to a
window, and are not alone in their interval, are moved; the intervals that remain after a whole window are the
repeated strings. No suffix of the whole is sorted again.

An anchor with more than ``CROWD`` differing segments is split by the content around
it: windows whose starts lie within a slice share all bytes but a few, and the hash of those
shared bytes is the new key; at last a slice is one window, and equal windows are one row.

Cases: null and empty texts have no bytes and no spans; texts shorter than a window are never
touched; rows without an id, and rows that repeat one, are told apart by their text (by 128 bits of hashes); equal rows
are copies of each other; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.llm import anchors
from rotapanel.llm.anchors import GRAM, WINDOW
from rotapanel.llm.hashing import slices, text_bytes
from rotapanel.llm.steps import written
from rotapanel.session import join_small, settle

REACH = WINDOW - GRAM  # bytes of a window beside its anchor
STEPS = REACH + 1  # symbols of a window, with the anchor as one
CROWD = 1_000
SLICES = [16, 1]  # starts per slice when a crowd is split
BUCKET = 2 << 20
PARTS = 1 << 18  # parts merged at a time
SHARDS = 4
_ANCHOR, _END = 0xFF, 0xFE  # bytes that UTF-8 never holds


def window_runs(docs: DataFrame) -> DataFrame:
    """Runs of windows with one anchor of docs (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc = batch.column(0)
                for r in anchors.anchor_runs(batch.column(1)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r["anchor"].view(np.int64)), pa.array(r["segment"].view(np.int64)), doc.take(pa.array(r["text"])),
                         pa.array(r["place"].astype(np.int32)), pa.array((r["place"] - r["first"]).astype(np.int32)),
                         pa.array((r["place"] - r["last"]).astype(np.int32))],
                        ["anchor", "segment", "doc", "place", "most", "least"],
                    )

    # A window starts `least` to `most` bytes before its anchor.
    return docs.mapInArrow(run, "anchor long, segment long, doc long, place int, most int, least int")


def segment_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, segment, most, least, n, bytes) of wanted (anchor, segment, doc, place, most, least, n)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "segment", "place", "most", "least", "n")).alias("parts"))
    rows = docs.join(lists, "doc").select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, off = text_bytes(batch.column(0))
                lists = batch.column(1)
                parts = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                place, most, least = (parts.field(c).to_numpy() for c in ("place", "most", "least"))
                lo = off[row] + place - most
                hi = off[row] + place - least + WINDOW
                yield pa.RecordBatch.from_arrays(
                    [parts.field("anchor"), parts.field("segment"), parts.field("most"), parts.field("least"), parts.field("n"),
                     pa.array([raw[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary())],
                    ["anchor", "segment", "most", "least", "n", "bytes"],
                )

    return rows.mapInArrow(run, "anchor long, segment long, most int, least int, n long, bytes binary")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of a shard by its first ``depth`` symbols at least.

    By doubling: ranks of h symbols and of the h behind them give ranks of 2h.
    """
    n, have = len(symbols), 7
    key = np.zeros(n, np.int64)
    for k in range(have):
        key <<= 8
        key[: n - k] |= symbols[k:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        if have >= depth or new.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank << 32
        key[:-have] |= rank[have:]
        have *= 2
    out = np.empty(n, np.int32)
    out[order] = np.arange(n, dtype=np.int32)
    return out


class Shard:
    """Burrows-Wheeler transform of some segments, each followed by an end symbol."""

    def __init__(self, symbols: np.ndarray):
        rank = suffix_order(symbols, STEPS)
        self.rank = rank
        before = np.append(symbols[-1:], symbols[:-1])
        self.bwt = np.empty(len(symbols), np.uint8)
        self.bwt[rank] = before
        # The rank that a suffix gets with the symbol before it.
        self.step = np.empty(len(symbols), np.int32)
        self.step[rank] = np.append(rank[-1:], rank[:-1])


def repeated_windows(segments: list[bytes], most: np.ndarray, least: np.ndarray, count: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its windows (from the first start on) occur more than once in its group."""
    anchor, end = bytes([_ANCHOR]), bytes([_END])
    coded = [np.frombuffer(s[:m] + anchor + s[m + GRAM :] + end, np.uint8) for s, m in zip(segments, most)]
    shard_of = np.arange(len(segments)) % min(SHARDS, len(segments))
    lengths = np.array([len(c) for c in coded])
    base = np.zeros(len(segments), np.int64)  # a segment's place in its shard
    bwt, step, rank_of, shift = [], [], [], []
    total = 0
    for s in range(shard_of.max() + 1):
        own = np.flatnonzero(shard_of == s)
        base[own] = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
        shard = Shard(np.concatenate([coded[k] for k in own]))
        bwt.append(shard.bwt)
        step.append(shard.step + total)
        rank_of.append(shard.rank + total)
        shift.append(total)
        total += len(shard.bwt)
    bwt, step, rank_of, shift = np.concatenate(bwt), np.concatenate(step), np.concatenate(rank_of), np.array(shift)
    # An element is a window; in round h it stands at the suffix behind its last h symbols but one.
    starts = most - least + 1
    owner = np.repeat(np.arange(len(segments)), starts)
    start = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    left = most[owner] - start  # bytes before the anchor
    place = base[owner] + start + STEPS
    at = rank_of[shift[shard_of[owner]] + place].astype(np.int32)
    key = group[owner].astype(np.int64) * (WINDOW + 1) + left
    # Round 0: intervals by group and distance, in them the shards one after the other.
    order = np.lexsort((at, key))
    element, at, key = order.astype(np.int32), at[order], key[order]
    new = np.empty(len(key), bool)
    new[:1], new[1:] = True, key[1:] != key[:-1]
    # Rounds go two symbols at a time, and one at last.
    pair, step2 = bwt.astype(np.uint16) | (bwt[step].astype(np.uint16) << np.uint16(8)), step[step]
    for h in range(0, STEPS + 2, 2):
        # Intervals with a single suffix are finished.
        several = ~(new & np.append(new[1:], True))
        element, at, block = element[several], at[several], np.cumsum(new, dtype=np.int32)[several]
        if h >= STEPS or not len(at):
            break
        symbol, move = (pair[at], step2) if h + 2 <= STEPS else (bwt[at], step)
        order = np.argsort(symbol, kind="stable")
        symbol, block, element = symbol[order], block[order], element[order]
        at = move[at[order]]
        new = np.empty(len(at), bool)
        new[:1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
    hit = count[owner] > 1
    hit[element] = True
    return np.split(hit, np.cumsum(starts)[:-1])


def _ranges(hit: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of marked windows, as bytes before the anchor: (of the first, of the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(most - a), int(most - b + 1)) for a, b in zip(edge[::2], edge[1::2])]


def resolve(units: DataFrame, buckets: int) -> DataFrame:
    """(key, part, hi, lo): repeated windows of units (key, part, most, least, n, bytes), as stretches."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("part", "ascending")])
        key, most, least, n = (table[c].to_numpy().astype(np.int64) for c in ("key", "most", "least", "n"))
        part = table["part"].to_numpy()
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        if not fresh.all():  # equal rows of the input
            table = table.filter(pa.array(fresh))
            key, most, least, n = key[fresh], most[fresh], least[fresh], n[fresh]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        hits = repeated_windows(table["bytes"].to_pylist(), most, least, n, group)
        found = [(k, hi, lo) for k, hit in enumerate(hits) for hi, lo in _ranges(hit, int(most[k]))]
        at = np.array([k for k, _, _ in found], np.int64)
        return pa.table({
            "key": table["key"].take(at), "part": table["part"].take(at),
            "hi": pa.array([h for _, h, _ in found], pa.int32()), "lo": pa.array([x for _, _, x in found], pa.int32()),
        })

    dealt = units.withColumn("bucket", F.expr(f"pmod(hash(key), {buckets})"))
    return dealt.groupBy("bucket").applyInArrow(run, "key long, part long, hi int, lo int")


def cut_units(units: DataFrame, width: int) -> DataFrame:
    """Units whose windows start in slices of ``width``; the new key hashes the bytes that a slice shares.

    Adds ``was`` and ``was_part``, the unit it comes from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, part, most, least, n, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                for bin_ in range(least // width, most // width + 1):
                    hi, lo = min(most, bin_ * width + width - 1), max(least, bin_ * width)
                    text = data[most - hi : most - lo + WINDOW]
                    # The bytes in every window of the slice; a unit has them even if it lacks some of the starts.
                    shared = data[most - bin_ * width : most - (bin_ * width + width - 1) + WINDOW]
                    mark = b"%d|%d|" % (key, bin_)
                    new_key = int.from_bytes(hashlib.blake2b(mark + shared, digest_size=8).digest(), "little", signed=True)
                    new_part = int.from_bytes(hashlib.blake2b(b"%d|" % hi + text, digest_size=8).digest(), "little", signed=True)
                    out.append((new_key, new_part, hi, lo, n, text, key, part))
            cols = list(zip(*out)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["key", "part", "most", "least", "n", "bytes", "was", "was_part"]
            )

    return units.select("key", "part", "most", "least", "n", "bytes").mapInArrow(
        run, "key long, part long, most int, least int, n long, bytes binary, was long, was_part long"
    )


def _bucket_count(size: int | None) -> int:
    return max(1, -(-(size or 0) // BUCKET))


def repeated_parts(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi): byte ranges of docs (doc, text) to remove; they may overlap."""
    runs = window_runs(docs)
    # Stored by itself, so that Spark can split the join where an anchor is very common.
    again = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    met = written(runs.join(again, "anchor"))
    # Any occurrence serves as example: equal segments have equal bytes.
    kinds = written(
        met.groupBy("anchor", "segment").agg(
            F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("place").alias("place"),
            F.first("most").alias("most"), F.first("least").alias("least"),
        )
    )
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    units = written(
        segment_bytes(docs, kinds.join(crowds.where("kinds > 1").select("anchor"), "anchor"))
        .withColumnRenamed("anchor", "key").withColumnRenamed("segment", "part")
    )
    results = []
    # Units of a later level know the anchor and segment of the first.
    origin = None
    for width in [*SLICES, None]:
        known = kinds.withColumnRenamed("anchor", "key") if origin is None else units
        size = F.col("most") - F.col("least") + WINDOW
        sizes = written(known.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(size).alias("size")))
        crowd = sizes.where(F.col("kinds") > (CROWD if width is not None else 1 << 62)).select("key")
        few = units.join(sizes.where("kinds > 1").join(crowd, "key", "left_anti").select("key"), "key")
        single = known.where("n > 1").join(sizes.where("kinds = 1").select("key"), "key")
        total = sizes.join(crowd, "key", "left_anti").where("kinds > 1").agg(F.sum("size")).first()[0]
        part = "segment" if origin is None else "part"
        single = single.selectExpr("key", f"{part} AS part", "most AS hi", "least AS lo")
        found = resolve(few, _bucket_count(total)).unionByName(single)
        if origin is not None:
            found = found.join(origin, ["key", "part"]).select(F.col("anchor").alias("key"), F.col("segment").alias("part"), "hi", "lo")
        results.append(written(found).selectExpr("key AS anchor", "part AS segment", "hi", "lo"))
        if width is None or crowd.isEmpty():
            break
        cut = written(cut_units(units.join(crowd, "key").dropDuplicates(["key", "part"]), width))
        came = cut.select("key", "part", F.col("was").alias("anchor"), F.col("was_part").alias("segment"))
        if origin is not None:
            came = came.join(
                origin.select(F.col("key").alias("anchor"), F.col("part").alias("segment"), F.col("anchor").alias("a0"), F.col("segment").alias("s0")),
                ["anchor", "segment"],
            ).select("key", "part", F.col("a0").alias("anchor"), F.col("s0").alias("segment"))
        origin = written(came)
        units = written(
            cut.groupBy("key", "part").agg(
                F.sum("n").alias("n"), F.first("most").alias("most"), F.first("least").alias("least"), F.first("bytes").alias("bytes")
            )
        )
    spans = results[0]
    for r in results[1:]:
        spans = spans.unionByName(r)
    return met.select("anchor", "segment", "doc", "place").join(spans, ["anchor", "segment"]).selectExpr(
        "doc", "place - hi AS lo", f"place - lo + {WINDOW} AS hi"
    )


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > far[:-1]
    at = np.flatnonzero(new)
    return list(zip(lo[at].tolist(), far[np.append(at[1:], len(lo)) - 1].tolist()))


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts (doc, lo, hi) with those that meet made one, task by task: a text of one letter has a part per byte."""

    def merge(table: pa.Table) -> pa.RecordBatch:
        doc, lo, hi = (table[c].to_numpy() for c in ("doc", "lo", "hi"))
        order = np.lexsort((lo, doc))
        doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        # Each text in a range of its own, so that one running maximum serves all.
        shift = (np.cumsum(first) - 1) * (int(hi.max()) + 1)
        far = np.maximum.accumulate(hi + shift)
        at = np.flatnonzero(first | np.concatenate([[True], (lo + shift)[1:] > far[:-1]]))
        ends = (far - shift)[np.append(at[1:], len(doc)) - 1]
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(lo[at].astype(np.int32)), pa.array(ends.astype(np.int32))], ["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = [], 0
        for batch in batches:
            have, rows = [*have, batch], rows + batch.num_rows
            if rows >= PARTS:
                yield merge(pa.Table.from_batches(have))
                have, rows = [], 0
        if rows:
            yield merge(pa.Table.from_batches(have))

    return parts.mapInArrow(run, "doc long, lo int, hi int")


def identity(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "id", "text")


def with_identity(docs: DataFrame) -> DataFrame:
    """Docs (id, text) with a number ``doc`` that only equal rows share.

    Rows whose first hash is another row's too, as told by a second one, are numbered by that second hash.
    """
    both = docs.select(identity(0).alias("doc"), identity(1).alias("other")).distinct()
    shared = settle(both.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"))
    docs = docs.withColumn("doc", identity(0))
    if shared.isEmpty():
        return docs
    marked = join_small(docs, shared.withColumn("shared", F.lit(True)), ["doc"], "left")
    return marked.withColumn("doc", F.when(F.col("shared"), identity(1)).otherwise(F.col("doc"))).drop("shared")


def remove_repeats(table: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also spans and the kept bytes."""
    docs = table.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = with_identity(docs)
    parts = merged_parts(repeated_parts(docs.select("doc", "text")).select("doc", "lo", "hi"))
    lists = parts.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    rows = docs.join(lists, "doc", "left").select("id", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, off = text_bytes(batch.column(1))
                flat, lists = batch.column(2).flatten(), batch.column(2)
                lo_all, hi_all = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                removed, spans, shas, kept = [], [], [], []
                for k in range(batch.num_rows):
                    data = raw[off[k] : off[k + 1]]
                    own = _union(lo_all[ends[k] : ends[k + 1]], hi_all[ends[k] : ends[k + 1]]) if ends[k + 1] > ends[k] else []
                    keep = np.ones(len(data), bool)
                    for a, b in own:
                        keep[a:b] = False
                    rest = data[keep].tobytes() if own else data.tobytes()
                    removed.append(len(data) - len(rest))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    shas.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if texts else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                     pa.array(shas, pa.string()), pa.array(spans if texts else [None] * len(spans), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept binary"
    ).withColumnRenamed("id", key)
    return out if texts else out.drop("spans", "kept")
