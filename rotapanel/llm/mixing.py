"""Mixing sources to target weights.

Token shares q of the sources are raised to an exponent a in [0, 1] and
normalised: 1 keeps the shares, 0 makes sources equal. The exponent is found by
repeated sectioning, either the largest whose mix has at least a target entropy,
or the smallest whose most repeated source stays within a limit of epochs.
Each source then gets ``weight * budget`` tokens: whole epochs, and for the rest
blocks of documents in the order of a hashed permutation, as far as the budget goes. Of the
block where it ends, documents are drawn in the order of their hash, up to the one whose end is
nearest to the budget, so a source misses its quota by half a document at most. Documents without a key are dealt to
blocks by their text.

Only aggregates per source, and 65 numbers per sectioning step, are looked at by
the driver. Cumulated sums go by hash range first, then within the one range
where the budget ends, so no source is ordered in one task.

Cases: a null source is a source of its own; texts that are null or empty have no
tokens and follow their block; sources without any token are not drawn; an empty
table gives an empty result; repeated rows are separate rows of the same block.
Extra columns stay; ``epoch``, ``block`` and ``block_key`` are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rotapanel.llm.sharding import text_hash
from rotapanel.llm.steps import written
from rotapanel.session import join_small, settle

MAX_REPEATS = 1.25
BLOCK_TOKENS = 20_000
SECTIONS, STEPS = 64, 5
RANGE_DIGITS = 2  # hex digits of the block key that give its range
_OWN = ["_src", "_tokens", "_full", "_rest", "_blocks", "_range", "_drawn", "_left", "_doc", "_n", "_take", "_copies"]


def word_count(text: Column) -> Column:
    """White-space separated words; null has none."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("bigint")


def _section(sources: DataFrame, measure, accept, rising: bool) -> float:
    """The exponent in [0, 1] where ``accept`` of the measure changes, to 2**-30.

    rising: exponents above the change are accepted, else those below it.
    """
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        points = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        tried = sources.select("*", F.posexplode(F.array(*map(F.lit, points))).alias("k", "a"))
        found = dict(tried.groupBy("k").agg(measure(F.col("a"))).collect())
        good = [accept(found.get(k)) for k in range(SECTIONS + 1)]
        if rising:
            k = next((k for k in range(SECTIONS + 1) if good[k]), SECTIONS)
            lo, hi = points[max(0, k - 1)], points[k]
        else:
            k = next((k for k in reversed(range(SECTIONS + 1)) if good[k]), 0)
            lo, hi = points[k], points[min(SECTIONS, k + 1)]
        if lo == hi:
            break
    return hi if rising else lo


def exponent(
    sources: DataFrame, budget: float, max_repeats: float | None = None, min_entropy: float | None = None
) -> float:
    """Exponent for sources (tokens) with a budget; entropy in nats."""
    share = F.col("share")
    if max_repeats is not None:
        # the largest of weight * budget / tokens; the smallest exponent that keeps to the limit
        def repeats(a: Column) -> Column:
            return F.max(F.pow(share, a) / F.col("_tokens")) * F.lit(budget) / F.sum(F.pow(share, a))

        return _section(sources, repeats, lambda m: m is not None and m <= max_repeats, True)
    if min_entropy is None:
        raise ValueError("give max_repeats or min_entropy")

    def entropy(a: Column) -> Column:
        u = F.pow(share, a)
        return F.log(F.sum(u)) - F.sum(u * F.log(u)) / F.sum(u)

    return _section(sources, entropy, lambda m: m is not None and m >= min_entropy, False)


def _part_of_blocks(inside: DataFrame, columns: list[str], tokens: Column, seed: str) -> DataFrame:
    """Of rows in one block a source, those in hash order that come nearest to ``_left`` tokens; equal rows are counted."""
    doc = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("")) for c in columns]))
    inside = written(inside.withColumn("_doc", doc).withColumn("_n", tokens).select(*columns, "_src", "_full", "block", "_left", "_doc", "_n"))
    docs = settle(
        inside.groupBy("_src", "_doc").agg(F.first("_left").alias("_left"), F.first("_n").alias("n"), F.count("*").alias("_copies"))
        .withColumn("_range", F.substring("_doc", 1, RANGE_DIGITS))
    )
    # As for blocks: by hash range first, then within the range where it ends.
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        docs.groupBy("_src", "_range")
        .agg(F.sum(F.expr("n * _copies")).alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    )
    parts = docs.join(ranges, ["_src", "_range"])
    within = Window.partitionBy("_src", "_range").orderBy("_doc")
    ends = parts.where("before + size > _left and before <= _left").withColumn("at", F.col("before") + F.sum(F.expr("n * _copies")).over(within) - F.expr("n * _copies"))
    # A copy that begins at b is drawn if 2 b + n <= 2 left.
    room = F.expr("2 * _left - n - 2 * at")
    ends = ends.withColumn("_take", F.when(room < 0, 0).when(F.col("n") == 0, F.col("_copies")).otherwise(F.least("_copies", F.floor(room / (2 * F.col("n"))) + 1)))
    takes = (
        parts.where("before + size <= _left").select("_src", "_doc", "_copies", F.col("_copies").alias("_take"))
        .unionByName(ends.where("_take > 0").select("_src", "_doc", "_copies", F.col("_take").cast("long").alias("_take")))
    )
    takes = settle(takes)
    every = join_small(inside, takes.where("_take = _copies").select("_src", "_doc"), ["_src", "_doc"], "left_semi")
    some = join_small(inside, takes.where("_take < _copies"), ["_src", "_doc"]).dropDuplicates(["_src", "_doc"])
    some = some.withColumn("_take", F.explode(F.expr("sequence(1L, _take)")))
    rows = [*columns, "_src", F.col("_full").alias("epoch"), "block"]
    return every.select(*rows).unionByName(some.select(*rows))


def mix_sources(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    max_repeats: float | None = MAX_REPEATS,
    min_entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = "mix",
) -> DataFrame:
    """One row per drawn document and epoch, with ``epoch``, ``block`` and ``block_key``.

    Reading in the order of (epoch, block_key) interleaves the blocks of all sources.
    The budget is the tokens of the input unless given.
    """
    columns = [c for c in df.columns if c not in ("epoch", "block", "block_key", *_OWN)]
    df = df.select(*columns).withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    tokens = word_count(F.col(text))
    sources = settle(df.select("_src", tokens.alias("n")).groupBy("_src").agg(F.sum("n").alias("_tokens")).where("_tokens > 0"))
    total = sources.agg(F.sum("_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    sources = sources.withColumn("share", F.col("_tokens") / F.lit(float(total or 1)))
    a = exponent(sources, float(budget), max_repeats, min_entropy) if total else 1.0
    mass = sources.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    quota = F.floor(F.pow("share", F.lit(a)) / F.lit(mass) * F.lit(float(budget)))
    plan = sources.withColumn("quota", quota).select(
        "_src",
        F.expr("quota div _tokens").cast("int").alias("_full"),
        F.expr("quota % _tokens").alias("_rest"),
        F.ceil(F.col("_tokens") / F.lit(float(block_tokens))).alias("_blocks"),
    )
    blocks_of = text_hash(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))) % F.col("_blocks")
    block_key = F.md5(F.concat_ws("|", F.lit(seed), F.col("_src"), F.col("_full").cast("string"), F.col("block").cast("string")))
    placed = join_small(df, plan, ["_src"]).withColumn("block", blocks_of)
    blocks = (
        placed.select("_src", "block", "_full", "_rest", tokens.alias("n"))
        .groupBy("_src", "block")
        .agg(F.first("_full").alias("_full"), F.first("_rest").alias("_rest"), F.sum("n").alias("n"))
        .withColumn("k", block_key)
        .withColumn("_range", F.substring("k", 1, RANGE_DIGITS))
    )
    blocks = settle(blocks)
    # Tokens before each hash range: at most 16 ** RANGE_DIGITS rows a source.
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        blocks.groupBy("_src", "_range")
        .agg(F.sum("n").alias("size"), F.first("_rest").alias("_rest"))
        .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .select("_src", "_range", "before", (F.col("before") + F.col("size") <= F.col("_rest")).alias("whole"))
    )
    within = Window.partitionBy("_src", "_range").orderBy("k", "block")
    parts = blocks.join(ranges, ["_src", "_range"])
    ends = settle(parts.where("not whole and before <= _rest").withColumn("upto", F.col("before") + F.sum("n").over(within)))
    drawn = (
        parts.where("whole").select("_src", "block").unionByName(ends.where("upto <= _rest").select("_src", "block")).withColumn("_drawn", F.lit(1))
    )
    out = join_small(placed, drawn, ["_src", "block"], "left")
    epochs = F.col("_full") + F.coalesce("_drawn", F.lit(0))
    kept = out.where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    cut = ends.where("upto > _rest and upto - n < _rest").select("_src", "block", F.expr("_rest - (upto - n)").alias("_left"))
    part = _part_of_blocks(join_small(placed, cut, ["_src", "block"]), columns, tokens, seed)
    kept = kept.select(*columns, "_src", "epoch", "block").unionByName(part)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("_src"), F.col("epoch").cast("string"), F.col("block").cast("string")))
    return kept.select(*columns, "epoch", "block", order.alias("block_key"))


def mix_sql(docs: str, columns: list[str], max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> str:
    """WITH entries ending in ``mixed`` (the rows drawn from ``docs``, which has ``columns``)."""
    parts = " || '|' || ".join(f"coalesce(md5({c}::VARCHAR), '')" for c in columns)
    section = f"""p0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"""
    for i in range(STEPS):
        section += f""",
m{i} AS (SELECT k, any_value(lo + (hi - lo) * k / {SECTIONS}.0::DOUBLE) AS a, any_value(lo) AS lo, any_value(hi) AS hi,
          max(pow(share, lo + (hi - lo) * k / {SECTIONS}.0::DOUBLE) / tokens) * any_value(total)
            / sum(pow(share, lo + (hi - lo) * k / {SECTIONS}.0::DOUBLE)) AS m
        FROM p{i}, range({SECTIONS + 1}) r(k), shares GROUP BY k),
p{i + 1} AS (SELECT (SELECT a FROM m{i} WHERE k = greatest(0, g - 1)) AS lo, (SELECT a FROM m{i} WHERE k = g) AS hi
        FROM (SELECT coalesce(min(k) FILTER (WHERE m <= {max_repeats}::DOUBLE), {SECTIONS}) AS g FROM m{i}))"""
    return f"""words AS (
  SELECT *, coalesce('=' || source, '') AS src,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM {docs}),
sums AS (SELECT src, sum(n)::BIGINT AS tokens FROM words GROUP BY src HAVING sum(n) > 0),
shares AS (SELECT src, tokens, sum(tokens) OVER ()::DOUBLE AS total, tokens / sum(tokens) OVER ()::DOUBLE AS share FROM sums),
{section},
quotas AS (SELECT src, tokens, floor(pow(share, hi) / sum(pow(share, hi)) OVER () * total)::BIGINT AS quota FROM shares, p{STEPS}),
plan AS (SELECT src, (quota // tokens)::INTEGER AS full_epochs, quota % tokens AS rest,
                ceil(tokens / {float(block_tokens)}::DOUBLE)::BIGINT AS blocks FROM quotas),
placed AS (SELECT w.*, full_epochs, rest,
                  ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:15])::BIGINT % blocks AS block
           FROM words w JOIN plan USING (src)),
blocks AS (SELECT src, block, any_value(rest) AS rest, sum(n) AS size,
                  md5('{seed}|' || src || '|' || any_value(full_epochs) || '|' || block) AS k FROM placed GROUP BY src, block),
summed AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY k, block ROWS UNBOUNDED PRECEDING) AS upto FROM blocks),
part AS (SELECT p.*, rest - (upto - size) AS room, md5('{seed}|' || {parts}) AS doc
         FROM (SELECT src, block, upto, size FROM summed WHERE upto > rest AND upto - size < rest) JOIN placed p USING (src, block)),
turn AS (SELECT *, row_number() OVER (PARTITION BY src, doc) - 1 AS copy, coalesce(sum(n) OVER (PARTITION BY src ORDER BY doc ROWS UNBOUNDED PRECEDING), 0) - n AS begun
         FROM part),
ends AS (SELECT *, min(begun) OVER (PARTITION BY src, doc) + copy * n AS begins FROM turn),
mixed AS (
  SELECT doc_id, source, block, unnest(range(full_epochs + CASE WHEN upto <= p.rest THEN 1 ELSE 0 END))::INTEGER AS epoch
  FROM placed p JOIN summed s USING (src, block)
  UNION ALL SELECT doc_id, source, block, full_epochs AS epoch FROM ends WHERE 2 * begins + n <= 2 * room)"""
