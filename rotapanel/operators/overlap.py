"""Panel overlap: counts, shared units, rotation schemes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotapanel.functions.reshape import to_wide, with_total
from rotapanel.operators.weights import PERIOD
from rotapanel.sources.microdata import MONTHS, QUARTERS


def counts_by_month(df: DataFrame, unit: list[str] | None, name: str) -> DataFrame:
    """Distinct units (or rows, without ``unit``) per quarter, one column per month and a total."""
    rows = df.select(*PERIOD, *(unit or []))
    if unit:
        rows = rows.distinct()
    long = rows.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias(name))
    wide = to_wide(long, ["trimestre"], "mes_trimestre", F.sum(name), MONTHS, fill=0)
    return with_total(wide, MONTHS)


def units_per_quarter(df: DataFrame) -> DataFrame:
    """Distinct households and sampling units per quarter.

    Both counts are made from distinct (quarter, unit, household) rows, so
    the two distinct aggregates share one reduced input.
    """
    homes = df.select("trimestre", "upm", "id_hogar").distinct()
    hogares = homes.groupBy("trimestre").agg(F.count(F.lit(1)).alias("hogares"))
    upm = df.select("trimestre", "upm").distinct().groupBy("trimestre").agg(F.count(F.lit(1)).alias("upm"))
    return hogares.join(upm, "trimestre")


def periods_of(df: DataFrame, unit: list[str], period: str = "trimestre") -> DataFrame:
    """Sorted list of the periods in which each unit was seen.

    The sets are built on the map side and hold each period once, so they are
    no longer than the file has periods.
    """
    return df.groupBy(*unit).agg(F.array_sort(F.collect_set(period)).alias("periodos"))


def shared_units(df: DataFrame, unit: list[str], period: str = "trimestre") -> DataFrame:
    """Number of units seen in both of every two periods.

    Pairs are formed inside each unit's list of periods, whose length is the
    number of periods of the file; lists are grouped first, so the pairs are
    made once per distinct list and not once per unit.
    """
    lists = periods_of(df, unit, period).where(F.size("periodos") > 1)
    patterns = lists.groupBy("periodos").agg(F.count(F.lit(1)).alias("n"))
    return (
        patterns.select("n", "periodos", F.explode("periodos").alias("trimestre_1"))
        .select("n", "trimestre_1", F.explode("periodos").alias("trimestre_2"))
        .where(F.col("trimestre_1") < F.col("trimestre_2"))
        .groupBy("trimestre_1", "trimestre_2")
        .agg(F.sum("n").alias("traslape"))
    )


def seen_in_all(df: DataFrame, unit: list[str], quarters: list[str]) -> DataFrame:
    """Units present in every one of the chosen quarters.

    One flag per quarter is combined on the map side, so a unit with many
    rows costs one row per task in the only shuffle.
    """
    flags = [F.max(F.col("trimestre") == q).alias(f"_in{i}") for i, q in enumerate(quarters)]
    seen = df.where(F.col("trimestre").isin(quarters)).groupBy(*unit).agg(*flags)
    for i in range(len(quarters)):
        seen = seen.where(f"_in{i}")
    return seen.select(*unit)


def overlap_share(df: DataFrame, unit: list[str]) -> DataFrame:
    """Shared units of two periods as a share of the units of the earlier one."""
    sizes = df.select("trimestre", *unit).distinct().groupBy("trimestre").agg(F.count(F.lit(1)).alias("n_1"))
    pairs = shared_units(df, unit)
    return pairs.join(sizes.withColumnRenamed("trimestre", "trimestre_1"), "trimestre_1").withColumn(
        "t", F.col("traslape") / F.col("n_1")
    )


def rotation_slots(
    spark: SparkSession,
    stay: int = 4,
    away: int = 0,
    spells: int = 1,
    periods: int = 6,
    start: int = 1,
    field: list[int] | None = None,
) -> DataFrame:
    """Panels in the field by period and slot, for a scheme stay(away)spells.

    One panel enters per step and is interviewed ``stay`` periods, rests for
    ``away`` and comes back until it has done ``spells`` spells. ``field``
    names the step of the scheme carried out in each period, so a repeated
    step models a sample taken over from the round before.
    """
    steps = field or list(range(start, start + periods))
    calendar = spark.createDataFrame([(p, s) for p, s in enumerate(steps, 1)], "period int, step int")
    life = spells * stay + (spells - 1) * away
    return (
        calendar.withColumn("age", F.explode(F.sequence(F.lit(life - 1), F.lit(0), F.lit(-1))))
        .where(F.col("age") % (stay + away) < stay)
        .withColumn("panel", F.col("step") - F.col("age"))
        .withColumn("slot", F.row_number().over(Window.partitionBy("period").orderBy("panel")))
        .select("period", "slot", "panel")
    )


def scheme_overlap(slots: DataFrame) -> DataFrame:
    """Shared panels of two periods over the panels of one, from a rotation table."""
    size = slots.groupBy("period").agg(F.count(F.lit(1)).alias("panels"))
    a, b = slots.alias("a"), slots.alias("b")
    shared = (
        a.join(b, (F.col("a.panel") == F.col("b.panel")) & (F.col("a.period") < F.col("b.period")))
        .groupBy(F.col("a.period").alias("period_1"), F.col("b.period").alias("period_2"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    first = size.withColumnRenamed("period", "period_1")
    pairs = first.alias("f").join(
        size.select(F.col("period").alias("period_2")), F.col("period_1") < F.col("period_2")
    )
    return (
        pairs.join(shared, ["period_1", "period_2"], "left")
        .select("period_1", "period_2", (F.coalesce("shared", F.lit(0)) / F.col("panels")).alias("share"))
    )


def presence(df: DataFrame, unit: list[str], first: str, second: str) -> DataFrame:
    """Flags of presence in two quarters, for every unit of the file."""

    def seen(q: str) -> Column:
        return F.max((F.col("trimestre") == q).cast("int"))

    return df.groupBy(*unit).agg(seen(first).alias("in_1"), seen(second).alias("in_2"))


def attrition_pattern(frame: DataFrame, unit: list[str]) -> DataFrame:
    """Number of units seen in both rounds, in one, or in neither."""
    a, b = F.col("in_1") == 1, F.col("in_2") == 1
    pattern = F.when(a & b, "ambos").when(a, "solo_t1").when(b, "solo_t2").otherwise("ninguno")
    return frame.groupBy(pattern.alias("patron")).agg(F.count(F.lit(1)).alias("n"))


def state_spells(
    df: DataFrame, unit: list[str], state: str, period: str = "trimestre", periods: list[str] | None = None
) -> DataFrame:
    """Runs of equal state per unit over consecutive periods; a period without observation ends a run.

    ``periods`` lists the codes in order. A unit is one row with its states in an array, from one grouped pass;
    runs are read off the array. A NULL state that was observed is a state.
    """
    codes = periods or QUARTERS
    last = len(codes) - 1
    here = [F.col(period) == p for p in codes]
    states = F.array(*[F.max(F.when(h, F.struct(F.lit(1).alias("seen"), F.col(state).alias("is")))) for h in here])
    per_unit = df.groupBy(*unit).agg(states.alias("_states"))
    at = F.sequence(F.lit(0), F.lit(last))

    def of(k: Column) -> Column:
        return F.get(F.col("_states"), k)

    def apart(k: Column, other: Column) -> Column:
        return of(k).isNotNull() & (of(other).isNull() | ~of(k)["is"].eqNullSafe(of(other)["is"]))

    # Beyond either end there is no element, so the first and the last run end there.
    starts = F.filter(at, lambda k: apart(k, k - 1))
    ends = F.filter(at, lambda k: apart(k, k + 1))
    runs = per_unit.select(*unit, "_states", F.inline(F.arrays_zip(starts.alias("_a"), ends.alias("_b"))).alias("_a", "_b"))
    names = F.array(*[F.lit(p) for p in codes])
    return runs.select(
        *unit, of(F.col("_a"))["is"].alias("estado"), F.get(names, F.col("_a")).alias("desde"), F.get(names, F.col("_b")).alias("hasta"),
        (F.col("_b") - F.col("_a") + 1).cast("long").alias("duracion"),
    )


def trajectories(spells: DataFrame, unit: list[str]) -> DataFrame:
    """Stable or fluctuating, by number of spells, with the longest duration."""
    per_unit = spells.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("episodios"),
        F.sum("duracion").alias("periodos"),
        F.max("duracion").alias("mas_larga"),
    )
    kind = F.when(F.col("episodios") == 1, "estable").otherwise("fluctuante")
    return per_unit.groupBy(kind.alias("trayectoria"), "periodos").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mas_larga").alias("duracion_media")
    )
