"""Exact removal of repeated word strings, by prefix-partitioned suffix trees.

A word goes if it lies in a window of ``WINDOW`` words that starts anywhere else too, in any text.

Which suffixes are worth a tree: the anchor of a window is its gram of ``GRAM`` words with the smallest hash.
Equal windows have equal anchors at one distance, so only suffixes around anchors that occur again can be the start of a
repeat. Neighbouring windows with one anchor are a segment, and equal segments count as one with their number. All
windows of a segment that occurs twice repeat; what is left to find is windows shared by different segments.

Their suffixes are spelled in symbols of ``SYMBOL`` words, ``DEPTH`` to a window. They are dealt to groups by
prefix: one symbol, or more where a group would hold more than ``GROUP`` suffixes. A
task takes the groups of its partition one after the other, sorts the suffixes of each and reads its tree off the common prefixes of
neighbours. An internal node as deep as a window is a repeat, all leaves below start one. Suffixes whose
prefix is crowded up to a whole window are equal windows: counting them says all, and they never meet in a task.

Words and symbols are 64-bit hashes, rows and segments are known by 128 bits. Stretches found in a
text are united in a window sorted by Spark.

Cases: null, empty and blank texts have no words, texts of fewer words than a window keep all; rows
without an id, and rows that repeat one, are told apart by their text; equal rows are copies of each other;
an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.llm import anchors
from rotapanel.llm.hashing import cuts, draws, mix, slices, text_bytes
from rotapanel.llm.steps import written
from rotapanel.session import join_small, settle

WINDOW, GRAM, SYMBOL = 35, 12, 5
DEPTH = WINDOW // SYMBOL
REACH = WINDOW - GRAM + 1  # places of an anchor in a window
PREFIXES = [1, 2, 4]  # symbols; beyond them a whole window
GROUP, ROWS, FEW = 10_000, 200_000, 5_000
PIECE = 1 << 20
SYMBOLS = [f"s{k}" for k in range(DEPTH)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE_BITS = np.uint64(21)


class Words:
    """Words of a text column: their hashes and byte ranges, and the first word of each text."""

    def __init__(self, column: pa.Array):
        self.raw, offsets = text_bytes(column)
        hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = cuts(self.raw, offsets)
        for lo, hi in zip(edges, edges[1:]):
            part = self.raw[lo:hi]
            word = ~_SPACE[part]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi)] - lo
            first[inner] |= word[inner]
            last[inner - 1] |= word[inner - 1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(start):
                hashes.append(anchors.Sums(part).ranges(start, end))
                starts.append(start + lo)
                ends.append(end + lo)
        self.hash, self.start, self.end = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, offsets)


def _rolled(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, scale in enumerate(draws(width, seed) | np.uint64(1)):
            out += words[k : k + n] * scale
        return mix(out)


def _range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = anchors._grown(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def anchored(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: (text, anchor hash, segment hash, anchor's place in its text, most and
    least words from a window's start to it). ``first`` is the first word of each text, and the end."""
    lo = 0
    while len(words) - lo >= WINDOW:
        part = words[lo : lo + PIECE]
        grams = _rolled(part, GRAM, 21)
        packed = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        anchor = (anchors._sliding_least(packed, REACH) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        text = np.searchsorted(first, np.arange(lo, lo + len(anchor)), side="right") - 1
        # Windows must not reach beyond their text.
        ok = first[text + 1] - lo >= np.arange(len(anchor)) + WINDOW
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(anchor)) - 1
        at, last = at[ok[at]], last[ok[at]]
        place = anchor[at]
        yield text[at], grams[place], _range_hashes(part, at, last + WINDOW), place + lo - first[text[at]], place - at, place - last
        lo += len(anchor)


def window_runs(docs: DataFrame) -> DataFrame:
    """(anchor, segment, d0, d1, place, most, least) of docs (d0, d1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch["text"])
                for text, anchor, segment, place, most, least in anchored(words.hash, words.first):
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), batch["d0"].take(at), batch["d1"].take(at),
                         *(pa.array(x.astype(np.int32)) for x in (place, most, least))],
                        ["anchor", "segment", "d0", "d1", "place", "most", "least"],
                    )

    return docs.mapInArrow(run, "anchor long, segment long, d0 long, d1 long, place int, most int, least int")


def suffixes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, segment, left, s0, ...): suffixes, in symbols, of segments wanted (anchor, segment, d0, d1, place, most, least)."""
    lists = wanted.groupBy("d0", "d1").agg(F.collect_list(F.struct("anchor", "segment", "place", "most", "least")).alias("parts"))
    rows = docs.join(lists, ["d0", "d1"]).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words = Words(batch["text"])
                symbol = _rolled(words.hash, SYMBOL, 22).view(np.int64)
                lists = batch["parts"]
                parts = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                place, most, least = (parts.field(c).to_numpy().astype(np.int64) for c in ("place", "most", "least"))
                count = most - least + 1
                own = np.repeat(np.arange(len(row)), count)
                left = most[own] - (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
                at = words.first[row[own]] + place[own] - left
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [parts.field("anchor").take(own), parts.field("segment").take(own), pa.array(left.astype(np.int32)),
                     *(pa.array(symbol[at + SYMBOL * k]) for k in range(DEPTH))],
                    ["anchor", "segment", "left", *SYMBOLS],
                )

    return rows.mapInArrow(run, "anchor long, segment long, left int, " + ", ".join(f"{s} long" for s in SYMBOLS))


def subtree(key: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of the groups: the order of leaves, and the symbols that each leaf shares with the one before (0 at a new group)."""
    order = np.lexsort((*symbols.T[::-1], key))
    key, symbols = key[order], symbols[order]
    same = np.concatenate([(key[1:] == key[:-1])[:, None], symbols[1:] == symbols[:-1]], axis=1)
    shared = np.zeros(len(key), np.int64)
    shared[1:] = np.logical_and.accumulate(same, axis=1).sum(1) - 1
    return order, np.maximum(shared, 0)


def nodes(shared: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Internal nodes of at least a depth, as ranges of leaves."""
    deep = np.flatnonzero(np.diff(np.concatenate([shared >= depth, [False]]).astype(np.int8), prepend=0))
    return [(int(a) - 1, int(b)) for a, b in zip(deep[::2], deep[1::2])]


def repeats_in_trees(keyed: DataFrame, parts: int) -> DataFrame:
    """(anchor, segment, left) of suffixes (key, anchor, segment, left, s0, ...) below a node as deep as a window."""
    names = ["key", "anchor", "segment", "left", *SYMBOLS]

    def found(table: pa.Table) -> pa.RecordBatch:
        symbols = np.stack([table[s].to_numpy() for s in SYMBOLS], axis=1)
        order, shared = subtree(table["key"].to_numpy(), symbols)
        leaves = [order[a:b] for a, b in nodes(shared, DEPTH)]
        at = pa.array(np.concatenate(leaves) if leaves else np.zeros(0, np.int64))
        return table.select(["anchor", "segment", "left"]).take(at).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # A group ends where the next key starts; the last one may go on in the next batch.
            key = batch["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (kept and kept[-1]["key"][-1].as_py() != key[0]):
                kept.append(batch.slice(0, cut))
                yield from found(pa.Table.from_batches(kept)).to_batches()
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from found(pa.Table.from_batches(kept)).to_batches()

    dealt = keyed.select(*names).repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "anchor long, segment long, left int")


def shared_windows(rows: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """(anchor, segment, left) of the stored suffixes whose window is also that of another one."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rest, keyed = rows, []
    for length in PREFIXES:
        rest = rest.withColumn("key", F.xxhash64(F.lit(length), *SYMBOLS[:length]))
        crowded = settle(rest.groupBy("key").count().where(F.col("count") > group).select("key"))
        if crowded.isEmpty():
            keyed.append(rest)
            rest = None
            break
        keyed.append(join_small(rest, crowded, ["key"], "left_anti"))
        rest = join_small(rest, crowded, ["key"], "left_semi")
    parts = max(min(cores, -(-size // FEW)), -(-size // ROWS), 1)
    out = repeats_in_trees(reduce(DataFrame.unionByName, keyed), parts)
    if rest is not None:
        # Stored by itself, so that Spark can split the join where a window is very common.
        again = written(rest.groupBy(*SYMBOLS).count().where("count > 1").select(*SYMBOLS))
        out = out.unionByName(rest.join(again, SYMBOLS).select("anchor", "segment", "left"))
    return out


def repeated_stretches(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(d0, d1, stretches): the word ranges of docs (d0, d1, text) to remove, in order and apart."""
    runs = window_runs(docs)
    # Stored by itself, so that Spark can split the join where an anchor is very common.
    again = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    met = written(runs.join(again, "anchor"))
    # Any occurrence serves as example: equal segments have equal words.
    kinds = written(
        met.groupBy("anchor", "segment").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("d0", "d1", "place", "most", "least")))
    )
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    spelled = written(suffixes(docs, kinds.join(mixed, "anchor")))
    bits = shared_windows(spelled, spelled.count(), group).select("anchor", "segment", F.expr("shiftleft(1L, left)").alias("bit"))
    # Windows of a segment are bits of a number; all are set where the segment occurs again.
    full = kinds.where("n > 1").select("anchor", "segment", F.expr("shiftleft(1L, most + 1) - shiftleft(1L, least)").alias("bit"))
    marks = bits.unionByName(full).groupBy("anchor", "segment").agg(F.bit_or("bit").alias("mask"))
    on = f"filter(sequence(0, {REACH - 1}), k -> shiftright(mask, k) % 2 = 1"
    lows, highs = f"{on} AND (k = 0 OR shiftright(mask, k - 1) % 2 = 0))", f"{on} AND shiftright(mask, k + 1) % 2 = 0)"
    spans = written(marks.select("anchor", "segment", F.expr(lows).alias("near"), F.expr(highs).alias("far")))
    found = met.join(spans, ["anchor", "segment"]).select("d0", "d1", "place", F.inline(F.arrays_zip("near", "far")))
    found = found.select("d0", "d1", F.expr("place - far AS lo"), F.expr(f"place - near + {WINDOW} AS hi"))
    sorted_ = Window.partitionBy("d0", "d1").orderBy("lo", "hi")
    before = F.max("hi").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", (F.col("lo") > F.coalesce(before, F.lit(-1))).cast("int"))
    apart = apart.withColumn("number", F.sum("new").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    united = apart.groupBy("d0", "d1", "number").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return united.groupBy("d0", "d1").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("stretches"))


def joined_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words to keep, a space behind each, and the end of each word's part (0 first)."""
    length = np.where(keep, words.end - words.start + 1, 0)
    edge = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(edge[-1]) + np.repeat(words.start - edge[:-1], length)
    out = words.raw[np.minimum(at, len(words.raw) - 1)] if len(at) else np.zeros(0, np.uint8)
    out[edge[1:][keep] - 1] = 0x20
    return out, edge


def remove_repeated_words(table: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False, group: int = GROUP) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256; with ``texts`` also stretches (of words) and the kept text."""
    docs = table.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("d0", F.xxhash64("id", "text")).withColumn("d1", F.xxhash64(F.lit("row"), "id", "text"))
    stretches = written(repeated_stretches(docs.select("d0", "d1", "text"), group))
    rows = docs.join(stretches, ["d0", "d1"], "left").select("id", "text", "stretches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, lists = Words(batch["text"]), batch["stretches"]
                flat = lists.flatten()
                count = lists.value_lengths().fill_null(0).to_numpy()
                base = words.first[:-1].repeat(count)
                edge = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edge, base + flat.field("lo").to_numpy(), 1)
                np.add.at(edge, base + flat.field("hi").to_numpy(), -1)
                keep = np.cumsum(edge)[:-1] == 0
                out, ends = joined_words(words, keep)
                kept = [out[ends[a] : max(ends[a], ends[b] - 1)].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
                gone = np.concatenate([[0], np.cumsum(~keep)])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array(np.diff(words.first).astype(np.int64)), pa.array(np.diff(gone[words.first])),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                     *([lists, pa.array(kept, pa.binary()).cast(pa.string())] if texts else [])],
                    schema.names,
                )

    schema = table.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    schema = schema.add("kept_sha256", "string")
    if texts:
        schema = schema.add(stretches.schema["stretches"]).add("kept", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)
