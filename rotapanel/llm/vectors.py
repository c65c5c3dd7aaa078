"""Near-duplicate vectors by sorted projection passes.

Vectors are compared only within a label. Equal vectors form a class. A pass gives every class a key of
random hashes (the signs of its projections, one after the other), sorts the classes of a label by
it and compares each with the next ``width`` ones; pairs at the threshold are confirmed in double
precision, and united over all passes. Two vectors at the threshold stay close in the order as
long as their first signs agree, so each pass finds them with a probability that depends on the signs it takes to
bring ``width`` classes together; ``passes`` follows from the count of the largest label.

That count holds for vectors that spread. To know whether it was enough, the exact links of a sample (``SAMPLE`` classes of
smallest hash, against all) are looked up in the components found; if one is missing, more passes follow with windows
of twice the width, until none is and the last passes joined nothing more. A window as wide as its label compares all pairs.

A label of more than ``CHUNK`` classes is cut, in the order of its keys, into chunks of about that size,
at other places in each pass; the last bits of a key are a hash of the class, so that equal signs don't make a chunk grow.

Links never leave a component, so the links of each vector are counted over its whole
component, in blocks whose pairs stay in their task.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without
label or id, are linked with nothing and kept, their component is their id; vectors of different
lengths are never linked; rows that repeat an id each come back and count as vectors; an empty table
gives an empty result; labels may have any type that groups; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotapanel.llm.components import connected_components
from rotapanel.llm.hashing import mix
from rotapanel.llm.steps import written
from rotapanel.session import join_small, settle

LEAST = 0.98
BITS, TIE_BITS = 48, 14  # signs of a key, and bits of the class's hash behind them
NEAR, MISS = 64, 1e-4
MORE = 4  # passes of each further round
CHUNK = 20_000
SAMPLE = 1_000
BLOCK = 128


def passes(count: int, least: float = LEAST, near: int = NEAR, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold was within a window, but for ``miss``.

    About log2(count / near) + 1 signs leave a window's worth of ``count`` spread vectors, and two vectors
    agree in a sign with probability 1 - angle / pi.
    """
    signs = max(0.0, math.log2(max(count, 1) / near) + 1)
    agree = (1 - math.acos(least) / math.pi) ** signs
    return max(1, math.ceil(math.log(miss) / math.log(max(1 - agree, 1e-12))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors; all lists must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sorted_keys(classes: DataFrame, number: int) -> DataFrame:
    """Adds ``place``: the signs of the pass's projections, most significant first, and a hash of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(BITS + TIE_BITS - 1, TIE_BITS - 1, -1, dtype=np.int64)
        for batch in batches:
            size = batch["size"].to_numpy()
            with np.errstate(over="ignore"):
                tie = mix(batch["cid"].to_numpy().astype(np.uint64) + np.uint64(number * 7919 + 1))
            place = (tie >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            for d in np.unique(size):
                if d not in drawn:
                    drawn[d] = np.random.default_rng([number, int(d)]).standard_normal((int(d), BITS))
                own = np.flatnonzero(size == d)
                place[own] += ((_matrix(batch["vector"].take(pa.array(own))) @ drawn[d]) >= 0) @ weight
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    rows = classes.select("label", "size", "cid", "vector")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())]))


def chunked(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``bits`` and ``chunk``: a label's order is cut by the first bits of the key, as many as leave ``CHUNK`` classes at most."""
    whole = BITS + TIE_BITS
    rows = join_small(keyed, sizes.select("label", "size", "bits"), ["label", "size"])
    chunk, group = F.expr(f"shiftright(place, {whole} - bits)"), ["label", "size", "bits", "chunk"]
    rows = rows.withColumn("chunk", chunk)
    if sizes.where("bits > 0").isEmpty():
        return rows
    while True:
        crowded = settle(rows.groupBy(*group).count().where(f"count > {CHUNK} AND bits < {whole}").select(*group, F.lit(8).alias("more")))
        if crowded.isEmpty():
            return rows
        more = F.least(F.col("bits") + F.coalesce("more", F.lit(0)), F.lit(whole))
        rows = join_small(rows, crowded, group, "left").withColumn("bits", more).drop("more").withColumn("chunk", chunk)


def _forest(near: np.ndarray, rows: np.ndarray, columns: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Of the links marked in a matrix between nodes, those that connect parts; ``part`` is kept up to date."""
    out = []
    for i in np.flatnonzero(near.any(1)):
        at = columns[near[i]]
        parts, where = np.unique(part[at], return_index=True)
        new = parts != part[rows[i]]
        if new.any():
            out += [(rows[i], k) for k in at[where[new]]]
            part[np.isin(part, parts[new])] = part[rows[i]]
    return out


def neighbour_links(x: np.ndarray, width: int, least: float) -> list[tuple[int, int]]:
    """Links of sorted unit vectors with the next ``width`` ones, as a forest."""
    n, found, part = len(x), [], np.arange(len(x))
    for lo in range(0, n, BLOCK):
        hi, far = min(n, lo + BLOCK), min(n, lo + BLOCK + width)
        rows, columns = np.arange(lo, hi), np.arange(lo, far)
        ahead = columns[None] - rows[:, None]
        near = (ahead > 0) & (ahead <= width)
        near &= x[lo:hi] @ x[lo:far].T >= least
        if near.any():
            found += _forest(near, rows, columns, part)
    return found


def window_links(dealt: DataFrame, width: int, least: float = LEAST) -> DataFrame:
    """Confirmed links (u, v) of neighbours in the order of the keys, chunk by chunk."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("cid", "ascending")]).combine_chunks()
        cid = table["cid"].to_numpy()
        found = neighbour_links(_matrix(table["vector"].chunk(0)), width, least)
        return pa.table({"u": pa.array([cid[i] for i, _ in found], pa.int64()), "v": pa.array([cid[j] for _, j in found], pa.int64())})

    return dealt.groupBy("label", "size", "bits", "chunk").applyInArrow(run, "u long, v long")


def sampled_links(classes: DataFrame, least: float = LEAST, count: int = SAMPLE) -> DataFrame:
    """All links (u, v) of the ``count`` classes of smallest hash."""
    sample = classes.select("label", "size", "cid", "vector").orderBy(F.xxhash64("cid"), "cid").limit(count).collect()
    own: dict = {}
    for r in sample:
        own.setdefault((r.label, r.size), []).append((r.cid, r.vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size, cid = batch["label"].to_pylist(), batch["size"].to_numpy(), batch["cid"].to_numpy()
            groups: dict = {}
            for k, key in enumerate(zip(label, size.tolist())):
                if key in own:
                    groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                mine = np.array([c for c, _ in own[key]])
                x = _matrix(pa.array([v for _, v in own[key]], pa.list_(pa.float64())))
                near = x @ _matrix(batch["vector"].take(pa.array(at))).T >= least
                i, j = np.nonzero(near & (mine[:, None] != cid[at][None]))
                yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(cid[at][j])], ["u", "v"])

    return classes.select("label", "size", "cid", "vector").mapInArrow(run, "u long, v long")


def missed(known: DataFrame, groups: DataFrame) -> int:
    """Known links whose ends are in different components."""
    ends = known.join(groups.selectExpr("cid AS u", "comp AS a"), "u", "left").join(groups.selectExpr("cid AS v", "comp AS b"), "v", "left")
    return ends.where("a IS NULL OR b IS NULL OR a <> b").count()


def found_groups(classes: DataFrame, least: float = LEAST, near: int = NEAR) -> DataFrame:
    """(cid, comp): components of the links found; classes without a link are left out."""
    sizes = settle(classes.groupBy("label", "size").agg(F.count("*").alias("m")).where("m > 1"))
    sizes = settle(sizes.withColumn("bits", F.expr(f"greatest(0, cast(ceil(log2(m / {CHUNK})) as int))")))
    most = sizes.agg(F.max("m")).first()[0] or 0
    if not most:
        return classes.select("cid", F.col("cid").alias("comp")).where("false")
    compared = join_small(classes, sizes.select("label", "size"), ["label", "size"], "left_semi")
    known = written(sampled_links(compared, least))
    links, width, number, merges = [], near, 0, None
    ends = passes(most, least, near)
    while True:
        while number < ends:
            # A window as wide as its label has compared all pairs: one pass will do.
            own = sizes if number == 0 else sizes.where(f"m > {width + 1}")
            if number and most <= width + 1:
                break
            rows = join_small(compared, own.select("label", "size"), ["label", "size"], "left_semi")
            links.append(written(window_links(chunked(sorted_keys(rows, number), own), width, least)))
            number += 1
        groups = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "cid")
        groups = written(groups.withColumnRenamed("component", "comp"))
        if most <= width + 1:
            return groups
        before, merges = merges, groups.where("cid <> comp").count()
        missing = missed(known, groups)
        # Where the sample showed a gap, a round that joins nothing more is the end.
        if not missing and before in (None, merges):
            return groups
        ends, width = number + MORE, min(2 * width, CHUNK)


def _blocks(members: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Rows of every two blocks of a group as a group (g, first, same) of its own, so that all pairs of it meet once."""
    # Blocks grow with the root of the group, so copies of a row stay few.
    sizes = members.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1")
    blocks = f"cast(ceil(m / greatest({BLOCK}, 4 * sqrt(m))) as int)"
    split = members.join(sizes, by).withColumn("blocks", F.expr(blocks))
    split = split.withColumn("slot", F.expr("pmod(hash(cid), blocks)"))
    return split.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.struct(*by, F.least("slot", "r").alias("a"), F.greatest("slot", "r").alias("b")).alias("g"),
        (F.col("slot") <= F.col("r")).alias("first"), (F.col("slot") == F.col("r")).alias("same"), *columns,
    )


def count_links(members: DataFrame, least: float = LEAST) -> DataFrame:
    """(cid, links): over all of its component (comp, cid, n, vector), the rows linked with a class, its own left out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, same, cid, n = (table[c].to_numpy(zero_copy_only=False) for c in ("first", "same", "cid", "n"))
        x = _matrix(table["vector"].chunk(0))
        links = np.zeros(len(cid), np.int64)
        if same[0]:
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            links = near @ n
        else:
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            near = x[a] @ x[b].T >= least
            links[a], links[b] = near @ n[b], near.T @ n[a]
        return pa.table({"cid": cid, "links": links})

    rows = _blocks(members, ["comp"], "cid", "n", "vector")
    return rows.groupBy("g").applyInArrow(run, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def group_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, near: int = NEAR
) -> DataFrame:
    """(key, n_links, component_id, kept) per row."""
    rows = table.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists("vector", lambda v: v != 0)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & sound & nonzero, F.lit(False))
    rows = rows.withColumn("good", good)
    classes = written(
        rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("cid"), F.count("*").alias("n"))
        .withColumn("size", F.size("vector"))
    )
    groups = found_groups(classes, least, near)
    links = count_links(classes.select("cid", "n", "vector").join(groups, "cid"), least)
    known = (
        classes.select("label", "vector", "cid", "n").join(groups, "cid", "left").join(links, "cid", "left")
        .where("n > 1 OR links IS NOT NULL")
        .select("label", "vector", F.coalesce("comp", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    )
    out = rows.where("good").join(known, ["label", "vector"], "left").unionByName(rows.where("NOT good"), allowMissingColumns=True)
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
