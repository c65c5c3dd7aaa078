"""Centroid clustering (k-means) in whole numbers, with Shallot search.

Components become integers, ``floor(SCALE * x)``, and every choice is made on exact squared distances,
so results don't depend on how rows are dealt. A vector remembers its centroid, the second-nearest one, an upper
bound of its distance to the first and a lower bound to all others. When centroids move, the bounds move along;
only vectors whose bounds overlap are looked at. They start from the closer of their
two remembered centroids and scan its neighbours in order of distance, while these lie in a ball whose radius is
the distance to the start plus the distance to the second-best found so far: it shrinks with every find.
Survivors are compared in integers. Bounds are floating and rounded outwards.

Vectors are packed once into blocks (a row each), in buckets. Per round only the narrow state of the
blocks is written, in the same buckets, so a round joins both without a shuffle; the sums of a block's clusters come
along in its state. Only centroids (k x dims numbers) reach the driver. The state before is dropped when
the next one is complete; each is a table in the shared folder, so lost executors cost a round at most.

Cases: vectors of another length, null, or with null or non-finite components are left out, and so
are those with a component of ``LIMIT`` and more in size, whose squared distances may not fit a long; rows that
repeat an id each count; rows without id are hashed as an empty id; rows that tie as first centroids
are ordered by their components; fewer vectors than k are a centroid each; an empty table gives an
empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.llm.steps import written
from rotapanel.session import bucketed, drop_table

SCALE, LIMIT = 1024, 1 << 17
BLOCK = 1024  # vectors of a row
BUCKET = 64 << 20  # bytes of vectors in a bucket
MOST_BUCKETS = 100_000
STATE = "block long, cluster binary, second binary, upper binary, lower binary, scanned long, parts array<struct<cluster: int, n: long, sums: array<long>>>"
_OUT, _ADD = 1 + 1e-12, 1e-9


def _up(x: np.ndarray) -> np.ndarray:
    return x * _OUT + _ADD


def _down(x: np.ndarray) -> np.ndarray:
    return x / _OUT - _ADD


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the row of c beside it."""
    gap = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """Centroids with what a search needs: neighbours in order of distance, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None):
        k = len(at)
        self.at = at
        far = np.stack([squared(at, row) for row in at])
        np.fill_diagonal(far, -1)
        # Without the centroid itself, which comes first.
        self.order = np.argsort(far, axis=1, kind="stable")[:, 1:]
        self.gap = _down(np.sqrt(np.take_along_axis(far, self.order, 1).astype(np.float64)))
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(1, np.inf)
        self.moved = np.zeros(k) if before is None else _up(np.sqrt(squared(at, before).astype(np.float64)))
        # The furthest move of any other centroid.
        top = np.argsort(self.moved)[::-1]
        self.others = np.full(k, self.moved[top[0]])
        self.others[top[0]] = self.moved[top[1]] if k > 1 else 0.0


def search(x: np.ndarray, c: Centroids, state: tuple[np.ndarray, ...] | None) -> tuple[tuple[np.ndarray, ...], int]:
    """State (cluster, second, upper, lower) of vectors after centroids have moved, and distances computed for it."""
    n, k = len(x), len(c.at)
    if state is None:
        state = np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.full(n, -np.inf)
    cluster, second, upper, lower = (s.copy() for s in state)
    upper, lower = _up(upper + c.moved[cluster]), _down(lower - c.others[cluster])
    open_ = np.flatnonzero(~(upper < np.maximum(lower, c.half[cluster])))
    exact = squared(x[open_], c.at[cluster[open_]])
    scanned = len(open_)
    upper[open_] = _up(np.sqrt(exact.astype(np.float64)))
    still = ~(upper[open_] < np.maximum(lower[open_], c.half[cluster[open_]]))
    rows, best_d = open_[still], exact[still]
    if k == 1 or not len(rows):
        return (cluster, second, upper, lower), scanned
    x = x[rows]
    best, next_ = cluster[rows], second[rows]
    next_d = squared(x, c.at[next_])
    scanned += len(rows)
    # Start from the closer one; the smaller number wins ties.
    swap = (next_d < best_d) | ((next_d == best_d) & (next_ < best))
    best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
    best_d, next_d = np.where(swap, next_d, best_d), np.where(swap, best_d, next_d)
    start, known = best.copy(), next_.copy()
    reach = _up(np.sqrt(best_d.astype(np.float64)))
    ball = reach + _up(np.sqrt(next_d.astype(np.float64)))
    live = np.arange(len(rows))
    for t in range(k - 1):
        live = live[c.gap[start[live], t] <= ball[live]]
        if not len(live):
            break
        j = c.order[start[live], t].astype(np.int32)
        new = j != known[live]
        at, j = live[new], j[new]
        d = squared(x[at], c.at[j])
        scanned += len(at)
        first = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
        then = ~first & ((d < next_d[at]) | ((d == next_d[at]) & (j < next_[at])))
        a = at[first]
        next_[a], next_d[a], best[a], best_d[a] = best[a], best_d[a], j[first], d[first]
        b = at[then]
        next_[b], next_d[b] = j[then], d[then]
        ball[at] = reach[at] + _up(np.sqrt(next_d[at].astype(np.float64)))
    cluster[rows], second[rows] = best, next_
    upper[rows], lower[rows] = _up(np.sqrt(best_d.astype(np.float64))), _down(np.sqrt(next_d.astype(np.float64)))
    return (cluster, second, upper, lower), scanned


def _sums(x: np.ndarray, cluster: np.ndarray) -> list[dict]:
    order = np.argsort(cluster, kind="stable")
    found, first = np.unique(cluster[order], return_index=True)
    total = np.add.reduceat(x[order], first, axis=0, dtype=np.int64)
    n = np.diff(first, append=len(cluster))
    return [{"cluster": int(c), "n": int(m), "sums": t.tolist()} for c, m, t in zip(found, n, total)]


def pack(kept: DataFrame, dims: int) -> DataFrame:
    """(block, ids, vectors) of kept (id, vector): rows packed in the order they come."""
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                vectors = pa.array([np.floor(x * SCALE).astype(np.int32).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, vectors], ["block", "ids", "vectors"])
                block += 1

    return kept.select("id", "vector").mapInArrow(run, f"block long, ids array<{kind}>, vectors binary")


def _matrix(value: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32).reshape(-1, dims)


def _state(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...] | None:
    if "cluster" not in batch.schema.names:
        return None
    kinds = {"cluster": np.int32, "second": np.int32, "upper": np.float64, "lower": np.float64}
    return tuple(np.frombuffer(batch[name][row].as_buffer(), kind) for name, kind in kinds.items())


def move_on(blocks: DataFrame, state: DataFrame | None, c: Centroids) -> DataFrame:
    """State of all blocks for new centroids."""
    dims = c.at.shape[1]
    rows = blocks.select("block", "vectors")
    if state is not None:
        rows = rows.join(state.select("block", "cluster", "second", "upper", "lower"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                x = _matrix(batch["vectors"][row], dims)
                new, scanned = search(x, c, _state(batch, row))
                out.append((*(s.tobytes() for s in new), scanned, _sums(x, new[0])))
            part = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
            types = [pa.binary()] * 4 + [pa.int64(), pa.list_(part)]
            yield pa.RecordBatch.from_arrays(
                [batch["block"], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(types))],
                ["block", "cluster", "second", "upper", "lower", "scanned", "parts"],
            )

    return rows.mapInArrow(run, STATE)


def nearest(blocks: DataFrame, state: DataFrame | None, c: Centroids) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = c.at.shape[1]
    rows = blocks if state is None else blocks.join(state.select("block", "cluster", "second", "upper", "lower"), "block")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = _matrix(batch["vectors"][row], dims)
                cluster = search(x, c, _state(batch, row))[0][0]
                distance = squared(x, c.at[cluster])
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][row].values, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"]
                )

    return rows.mapInArrow(run, f"id {kind}, cluster int, distance long")


def _moved(at: np.ndarray, state: DataFrame) -> np.ndarray:
    """Floor of the mean of every cluster; empty ones stay."""
    parts = state.select(F.explode("parts").alias("p")).select("p.cluster", "p.n", F.posexplode("p.sums").alias("place", "s"))
    total = parts.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = at.copy()
    for row in total.collect():
        out[row.cluster, row.place] = int(row.s) // row.n
    return out


def cluster_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Rows (id, cluster, distance) of all vectors kept, the final centroids, and the distances computed in each round."""
    spark = table.sparkSession
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def sound(v: Column) -> Column:
        return v.isNotNull() & (F.abs(v) < float(LIMIT))  # NaN is above all numbers

    kept = rows.where(F.coalesce((F.size("vector") == dims) & F.forall("vector", sound), F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    whole = F.transform("vector", lambda v: F.floor(v * SCALE))
    at = np.array([r.v for r in kept.select(digest.alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()], np.int64)
    if not len(at):
        return rows.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), at.reshape(0, dims), []
    n = kept.count()
    least = min(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    buckets = min(MOST_BUCKETS, max(least, -(-n * dims * 4 // BUCKET)))
    packed, blocks = bucketed(pack(kept, dims), ["block"], buckets)
    name, state, before, work = None, None, None, []
    for _ in range(rounds):
        old = name
        name, state = bucketed(move_on(blocks, state, Centroids(at, before)), ["block"], buckets, dealt=True)
        drop_table(spark, old)
        work.append(state.agg(F.sum("scanned")).first()[0])
        before, at = at, _moved(at, state)
        if (before == at).all():
            break  # all later rounds are the same
    done = written(nearest(blocks, state, Centroids(at, before)))
    drop_table(spark, name)
    drop_table(spark, packed)
    return done, at, work


def cluster_table(table: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    done, at, _ = cluster_vectors(table, key, **options)
    own = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(own.values())
    facts = [(j, own.get(j, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(at)]
    schema = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"
    centres = table.sparkSession.createDataFrame([(a, Decimal(b), Decimal(c), d) for a, b, c, d in facts], schema)
    out = done.join(F.broadcast(centres), "cluster")  # k rows
    long = [F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("cluster_inertia", "inertia")]
    return out.select(F.col("id").alias(key), "cluster", "distance", *long, "centroid_sha256")
