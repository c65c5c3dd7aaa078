"""Sharding by a lookup table that shards fill in turns.

Every shard has a preference order over the slots of a prime-sized table:
``(offset + j * skip) mod slots``, both from a hash of its name. Shards take turns
and claim the first free slot they prefer, so slot counts differ by at most one.
A row goes to the shard that owns the slot of its key's hash. When shards come
or go, most slots keep their owner.

Cases: null keys are placed by the hash of the other given columns; an empty
table gives an empty result; repeated keys share a slot. Columns named ``slot``
or ``shard`` in the input are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 16, 2003
MAX_SLOTS = 100_003  # bounds the broadcast table
PROBES = 64


def text_hash(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row (slot, shard) per slot."""
    if not _prime(slots) or not 0 < shards <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards up to {MAX_SLOTS}")
    name = F.concat(F.lit("shard-"), F.col("id").cast("string"))
    order = spark.range(shards).select(
        F.col("id"),
        (text_hash(F.concat(name, F.lit("|offset"))) % slots).alias("offset"),
        (text_hash(F.concat(name, F.lit("|skip"))) % (slots - 1) + 1).alias("skip"),
    )
    # One row: the orders of a bounded number of shards.
    row = order.agg(F.array_sort(F.collect_list(F.struct("id", "offset", "skip"))).alias("orders"))

    def claim(acc: Column, turn: Column) -> Column:
        who = (turn % shards).cast("int")
        mine = F.get(F.col("orders"), who)
        start = F.get(acc["next"], who)

        def slot(j: Column) -> Column:
            return (mine["offset"] + j * mine["skip"]) % slots

        def first(last: Column) -> Column:
            free = F.filter(F.sequence(start, last), lambda j: F.get(acc["owner"], slot(j).cast("int")) < 0)
            return F.get(free, F.lit(0))

        last = F.lit(slots - 1).cast("bigint")
        # Few probes suffice as a rule; the whole rest of the order is looked through otherwise.
        j = F.coalesce(first(F.least(start + PROBES, last)), first(last))
        return F.transform(
            F.array(j),
            lambda j: F.struct(
                F.concat(
                    F.slice(acc["owner"], F.lit(1), slot(j).cast("int")),
                    F.array(who),
                    F.slice(acc["owner"], slot(j).cast("int") + 2, F.lit(slots)),
                ).alias("owner"),
                F.transform(acc["next"], lambda n, k: F.when(k == who, F.least(j + 1, last)).otherwise(n)).alias("next"),
            ),
        )[0]

    empty = F.struct(
        F.array_repeat(F.lit(-1), slots).alias("owner"),
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("next"),
    )
    filled = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), empty, claim, lambda acc: acc["owner"])
    return row.select(F.posexplode(filled).alias("slot", "shard"))


def place(
    df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, instead: str | None = None
) -> DataFrame:
    """Adds ``slot`` and ``shard``; rows without a key are placed by the column ``instead``."""
    text = F.col(key).cast("string")
    if instead is not None:
        text = F.coalesce(text, F.col(instead).cast("string"))
    df = df.drop("slot", "shard").withColumn("slot", (text_hash(F.coalesce(text, F.lit(""))) % slots).cast("int"))
    # The table has `slots` rows, whatever the data.
    return df.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot")


def lookup_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """WITH RECURSIVE entries that fill the same table."""
    h = "('0x' || md5(x)[1:15])::BIGINT"
    return f"""orders AS (
  SELECT list(o ORDER BY i) AS o, list(s ORDER BY i) AS s FROM (
    SELECT i, {h.replace('x)', "'shard-' || i || '|offset')")} % {slots} AS o,
           {h.replace('x)', "'shard-' || i || '|skip')")} % {slots - 1} + 1 AS s
    FROM range({shards}) t(i))),
turns AS (
  SELECT 0::BIGINT AS k, list_transform(range({slots}), lambda x: -1::BIGINT) AS owner,
         list_transform(range({shards}), lambda x: 0::BIGINT) AS nxt
  UNION ALL
  SELECT k + 1, list_transform(owner, lambda w, i: CASE WHEN i = (o[k % {shards} + 1] + j * s[k % {shards} + 1]) % {slots} + 1
                                                 THEN k % {shards} ELSE w END),
         list_transform(nxt, lambda n, i: CASE WHEN i = k % {shards} + 1 THEN j + 1 ELSE n END)
  FROM (SELECT t.*, o, s, list_filter(range(nxt[k % {shards} + 1], {slots}),
               lambda x: owner[(o[k % {shards} + 1] + x * s[k % {shards} + 1]) % {slots} + 1] < 0)[1] AS j
        FROM turns t, orders WHERE k < {slots})),
lookup AS (
  SELECT unnest(range({slots}))::INTEGER AS slot, unnest(owner)::INTEGER AS shard FROM turns WHERE k = {slots})"""
