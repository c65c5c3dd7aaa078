"""Near-duplicate documents by MinHash.

A document's set holds its distinct five-word shingles. Documents with one set form a
class; of each class one signature of ``HASHES`` universal hash minima goes on.
Signatures are cut into ``BANDS`` bands; classes that agree on a band share a bucket.

Links are found in two rounds, and confirmed on full sets. First every class of a bucket is
compared with one centre, picked by the bucket's key. Then, in buckets whose classes
are still in several components, the classes outside the largest component are
compared with all others, in blocks: a pair is tested in the first bucket that it
shares, if its signatures allow the threshold, and unless it is connected already.
No block emits more than a spanning forest of its links, so the number of pairs never
leaves a task, and no link between components is lost. Components come from alternating large-star and
small-star.

A pair at the threshold of 80 % shares no bucket with probability (1 - 0.8**5)**30 < 1e-5, at
85 % < 1e-7; a signature five standard deviations below the threshold rules a pair out.

Cases: null, empty or blank texts have empty sets, are linked with nothing and kept; a text of
fewer words than a shingle is one shingle; rows without doc_id are linked with nothing and kept, with
a null component; rows that repeat a doc_id are one node of the components that are returned, and each
comes back, but for removal each of their texts stands for itself; an empty table gives an empty
result; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotapanel.llm import hashing
from rotapanel.llm.components import connected_components
from rotapanel.llm.steps import written
from rotapanel.session import join_small, settle

WORDS, ROWS, BANDS = 5, 5, 30
HASHES = ROWS * BANDS
PERCENT = 80
BLOCK = 256


def signatures(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc, th, n, hi, lo, sig): hash of the text, set size, 128-bit hash of the set, minima of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                sets = hashing.shingle_sets(batch.column(1), words)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                hi, lo = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                sig: list[bytes | None] = [None] * len(n)
                if len(some):
                    full = [sets[k] for k in some]
                    first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    values = np.concatenate(full)
                    with np.errstate(over="ignore"):
                        hi[some] = np.add.reduceat(hashing.mix(values), first).view(np.int64)
                        lo[some] = np.add.reduceat(hashing.mix(values ^ np.uint64(0x5BF03635)), first).view(np.int64)
                    least = hashing.minima(full, HASHES)
                    for k, row in zip(some, least):
                        sig[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n), pa.array(hi), pa.array(lo), pa.array(sig, pa.binary())],
                    ["doc", "th", "n", "hi", "lo", "sig"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return rows.mapInArrow(run, "doc long, th long, n long, hi long, lo long, sig binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, bucket, cid): a row per band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = hashing.draws(ROWS, 5) | np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                keys = (sig.astype(np.uint64) * scale).sum(2, dtype=np.uint64)
                keys = hashing.mix(keys + hashing.draws(BANDS, 6))
            cid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(cid))), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cid, BANDS))],
                ["band", "bucket", "cid"],
            )

    return classes.select("cid", "sig").mapInArrow(run, "band int, bucket long, cid long")


def _agree(mine: np.ndarray, theirs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of signatures: whether they allow the threshold, and their first common band."""
    p = percent / 100
    least = HASHES * (p - 5 * math.sqrt(p * (1 - p) / HASHES))
    allow = np.empty((len(mine), len(theirs)), bool)
    first = np.empty((len(mine), len(theirs)), np.int16)
    for k, row in enumerate(mine):
        same = row == theirs
        allow[k] = same.sum(1) >= least
        bands = same.reshape(len(theirs), BANDS, ROWS).all(2)
        first[k] = np.where(bands.any(1), bands.argmax(1), -1)
    return allow, first


def _links(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs marked in a matrix, those at the threshold, on full sets."""
    out = []
    for k in np.flatnonzero(pairs.any(1)):
        others = np.flatnonzero(pairs[k])
        values = np.concatenate([sets[j] for j in others])
        owner = np.repeat(np.arange(len(others)), [len(sets[j]) for j in others])
        at = np.minimum(np.searchsorted(sets[k], values), len(sets[k]) - 1)
        both = np.bincount(owner[sets[k][at] == values], minlength=len(others))
        either = len(sets[k]) + np.array([len(sets[j]) for j in others]) - both
        out += [(k, j) for j in others[100 * both >= percent * either]]
    return out


def _forest(ids: np.ndarray, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what the others connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in links:
        a, b = find(int(ids[i])), find(int(ids[j]))
        if a != b:
            root[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def confirm(groups: DataFrame, candidates: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Links (u, v) in groups (g, band, side, cid, comp); band is -1 where every pair counts.

    Sides 0 and 1 are compared with each other, side 2 within itself.
    """

    def run(table: pa.Table) -> pa.Table:
        side, cid, comp = (table[c].to_numpy() for c in ("side", "cid", "comp"))
        band = table["band"][0].as_py()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        allow, first = _agree(sig, sig, percent)
        pairs = allow & (comp[:, None] != comp[None, :]) & (cid[:, None] != cid[None, :])
        if band >= 0:
            pairs &= first == band
        pairs &= ((side[:, None] == 0) & (side[None, :] == 1)) | ((side[:, None] == 2) & (cid[:, None] < cid[None, :]))
        used = np.flatnonzero(pairs.any(0) | pairs.any(1))
        found = []
        if len(used):
            sets = hashing.shingle_sets(table["text"].take(pa.array(used)), words)
            found = _forest(cid[used], _links(sets, pairs[np.ix_(used, used)], percent))
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    rows = groups.join(candidates, "cid").select("g", "band", "side", "cid", "comp", "sig", "text")
    return rows.groupBy("g").applyInArrow(run, "u long, v long")


def _blocks(n: str) -> str:
    return f"cast(ceil(({n}) / {BLOCK}) as int)"


def class_links(docs: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, th, n, cid) per row, classes (cid, doc, th) with one of their texts, and links (u, v) between classes."""
    rows = written(signatures(docs, key, text))
    # Texts of one id can be in several classes, so a class has a number of its own.
    classes = written(
        rows.where("n > 0 AND doc IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(F.min(F.struct("doc", "th")).alias("one"), F.min_by("sig", "doc").alias("sig"))
        .select("hi", "lo", "one.doc", "one.th", "sig", F.monotonically_increasing_id().alias("cid"))
    )
    bands = band_keys(classes)
    # The centre: xor with the bucket's key picks another class in each bucket. Stored by itself, so
    # that Spark can split the join with the members where a bucket is large.
    buckets = written(
        bands.groupBy("band", "bucket")
        .agg(F.count("*").alias("m"), F.min(F.col("cid").bitwiseXOR(F.col("bucket"))).alias("c"))
        .where("m > 1")
        .select("band", "bucket", "m", F.col("c").bitwiseXOR(F.col("bucket")).alias("centre"))
    )
    members = written(bands.join(buckets, ["band", "bucket"]))
    ids = members.select("cid").distinct()
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    own = texts.join(classes.select("doc", "th", "cid", "sig").join(ids, "cid"), ["doc", "th"]).select("cid", "sig", "text")
    repeated = settle(rows.groupBy("doc", "th").count().where("count > 1").join(classes, ["doc", "th"]).select("cid"))
    if not repeated.isEmpty():
        once = join_small(own, repeated, ["cid"], "left_semi").dropDuplicates(["cid"])
        own = join_small(own, repeated, ["cid"], "left_anti").unionByName(once)
    candidates = written(own)

    # First round: a star around each centre, in chunks.
    stars = members.where("cid <> centre").select("centre", "cid").distinct()
    degrees = stars.groupBy("centre").agg(F.expr(_blocks("count(*)")).alias("chunks"))
    spokes = stars.join(degrees, "centre").withColumn("chunk", F.expr("pmod(hash(cid), chunks)"))
    hubs = spokes.select("centre", "chunk").distinct().withColumn("cid", F.col("centre"))

    def star(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            F.struct("centre", F.lit(-1).alias("part"), "chunk").alias("g"), F.lit(-1).alias("band"), F.lit(side).alias("side"),
            "cid", F.col("cid").alias("comp"),
        )

    links = written(confirm(star(spokes, 1).unionByName(star(hubs, 0)), candidates, percent))

    # Second round: what is still apart within a bucket.
    parts = connected_components(links).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    apart = members.where("m > 2").join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = apart.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"))
    several = (
        sizes.groupBy("band", "bucket")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("m"), F.count("*").alias("comps"))
        .where("comps > 1")
        .selectExpr("band", "bucket", "main", f"{_blocks('n_main')} AS mains", f"{_blocks('m - n_main')} AS rests", "m - n_main > 1 AS many")
    )
    apart = written(apart.select("band", "bucket", "cid", "comp").join(several, ["band", "bucket"]))
    slot = "pmod(hash(cid), if(comp = main, mains, rests))"
    apart = apart.withColumn("slot", F.expr(slot))

    def block(df: DataFrame, part: str, side: str, a: str, b: str) -> DataFrame:
        return df.selectExpr(
            f"struct(bucket, {part} AS part, {a} AS a, {b} AS b) AS g", "band", f"{side} AS side", "cid", "comp"
        )

    main, rest = apart.where("comp = main"), apart.where("comp <> main")
    blocks = (
        block(main.withColumn("r", F.expr("explode(sequence(0, rests - 1))")), "1", "1", "r", "slot")
        .unionByName(block(rest.withColumn("r", F.expr("explode(sequence(0, mains - 1))")), "1", "0", "slot", "r"))
        .unionByName(
            block(
                rest.where("many").withColumn("r", F.expr("explode(sequence(0, rests - 1))")),
                "2", "if(r = slot, 2, if(slot < r, 0, 1))", "least(r, slot)", "greatest(r, slot)",
            )
        )
    )
    more = written(confirm(blocks, candidates, percent))
    named = rows.select("doc", "th", "n", "hi", "lo").join(classes.select("hi", "lo", "cid"), ["hi", "lo"], "left")
    cid = F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.col("cid")).alias("cid")
    return written(named.select("doc", "th", "n", cid)), classes.select("cid", "doc", "th"), links.unionByName(more)


def group_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row; one document of each component is kept."""
    named, classes, links = class_links(docs, key, text, percent)
    # The classes of one id are one node.
    spread = named.where("cid IS NOT NULL").groupBy("doc").agg(F.min("cid").alias("u"), F.max("cid").alias("last"))
    spread = settle(spread.where("u < last").select("doc", "u"))
    same = named.join(spread, "doc").where("cid <> u").select("u", F.col("cid").alias("v")).distinct()
    groups = connected_components(links.unionByName(same)).withColumnRenamed("node", "cid")
    groups = settle(groups.withColumnRenamed("component", "root"))
    least = groups.join(classes, "cid").groupBy("root").agg(F.min("doc").alias("component"))
    parts = written(groups.join(least, "root").select("cid", "component"))
    out = named.join(parts, "cid", "left").join(classes.select("cid", F.col("doc").alias("first")), "cid", "left")
    out = written(out.select("doc", "n", F.coalesce("component", "first").alias("component")))
    # Empty texts have no class and follow the other texts of their id.
    empty = out.where("n = 0 AND doc IS NOT NULL").select("doc").distinct()
    moved = out.where("component <> doc").join(empty, "doc").select("doc", F.col("component").alias("other")).distinct()
    out = join_small(out, moved, ["doc"], "left").withColumn("component", F.coalesce("component", "other", "doc"))
    return out.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"),
    )


def remove_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all columns; of rows that repeat an id and its text, one stays."""
    named, classes, links = class_links(docs, key, text, percent)
    groups = connected_components(links).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    groups = written(classes.join(groups, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    stays = groups.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("one"))
    stays = groups.join(stays, "root").select("cid", "one")
    judged = named.where("doc IS NOT NULL").join(stays, "cid", "left")
    judged = written(judged.select("doc", "th", F.coalesce(F.struct("doc", "th") == F.col("one"), F.lit(True)).alias("kept")))
    row = [F.col("doc").alias("_id"), F.col("th").alias("_th")]
    gone = judged.where("NOT kept").select(*row).distinct()
    again = settle(judged.where("kept").groupBy(*row).count().where("count > 1").select("_id", "_th"))
    marked = docs.withColumns({"_id": F.col(key).cast("long"), "_th": F.xxhash64(text)})
    left = join_small(marked, gone, ["_id", "_th"], "left_anti")
    if again.isEmpty():
        return left.drop("_id", "_th")
    repeated = join_small(left, again, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    return join_small(left, again, ["_id", "_th"], "left_anti").unionByName(repeated).drop("_id", "_th")
