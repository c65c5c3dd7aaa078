"""Gross flows between states of two rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.recode import label
from rotapanel.functions.reshape import complete_grid, to_wide
from rotapanel.operators.design import SurveyDesign
from rotapanel.operators.estimation import survey_total


def flow_counts(base: DataFrame, s1: str, s2: str, levels: list) -> DataFrame:
    """Transition counts; NULL is the state of those who did not answer."""
    counts = base.groupBy(s1, s2).agg(F.count(F.lit(1)).alias("n"))
    return complete_grid(counts, {s1: levels, s2: levels}, {"n": 0})


def flow_weights(base: DataFrame, s1: str, s2: str, weight: str) -> DataFrame:
    """Cells with count and weight, from one grouped pass."""
    return base.groupBy(F.col(s1).alias("state_1"), F.col(s2).alias("state_2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")
    )


def labelled_matrix(cells: DataFrame, s1: str, s2: str, value: str, names: dict, missing: str, fill=0) -> DataFrame:
    """Wide flow table with one labelled row and column per state."""
    named = cells.withColumns({s1: label(s1, names, missing), s2: label(s2, names, missing)})
    return to_wide(named, [s1], s2, F.first(value), [*names.values(), missing], fill=fill)


def flow_totals(design: SurveyDesign, s1: str, s2: str) -> DataFrame:
    """Weighted transition totals with standard errors."""
    return survey_total(design, [s1, s2])


def total_with_error(total: str = "total", se: str = "se"):
    """Text "total (se)", both rounded half to even."""
    def whole(c: str):
        return F.bround(F.col(c), 0).cast("long").cast("string")

    return F.concat(whole(total), F.lit(" ("), whole(se), F.lit(")"))


def answered_both(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("state_1").isNotNull() & F.col("state_2").isNotNull())


def row_complement(cells: DataFrame, value: str) -> DataFrame:
    return cells.where(F.col("state_1").isNotNull() & F.col("state_2").isNull()).select(
        "state_1", F.col(value).alias("complemento_fila")
    )


def column_complement(cells: DataFrame, value: str) -> DataFrame:
    return cells.where(F.col("state_1").isNull() & F.col("state_2").isNotNull()).select(
        "state_2", F.col(value).alias("complemento_columna")
    )


def flow_table(cells: DataFrame, value: str, levels: list, corner: str = "missing") -> DataFrame:
    """Flow table with row complement, column complement and corner.

    ``corner`` is "missing" (those who answered in neither round) or
    "column_sum" (the sum of the column complement).
    """
    v = F.col(value)
    zero = F.lit(0)
    first, second = F.col("state_1"), F.col("state_2")
    columns = [F.sum(F.when(second == x, v).otherwise(zero)).alias(f"s_{x}") for x in levels]
    # Every state has a row, whether or not anyone answered in both rounds.
    sums = cells.where(first.isNotNull()).groupBy(first.cast("string").alias("estado")).agg(
        *columns, F.sum(F.when(second.isNull(), v).otherwise(zero)).alias("complemento_fila")
    )
    states = cells.sparkSession.createDataFrame([(str(x),) for x in levels], "estado string")
    inner = states.join(sums, "estado", "left").na.fill(0)
    in_corner = second.isNull() if corner == "missing" else second.isNotNull()
    last = cells.where(first.isNull()).agg(
        *[F.coalesce(c, zero).alias(f"s_{x}") for c, x in zip(columns, levels)],
        F.coalesce(F.sum(F.when(in_corner, v).otherwise(zero)), zero).alias("complemento_fila"),
    ).select(F.lit("Complemento columna").alias("estado"), "*")
    return inner.unionByName(last)


def allocate_by_weights(linked: DataFrame, s1: str, s2: str, w1: str, w2: str) -> DataFrame:
    """Flows with entries and exits from the change of each person's weight.

    The smaller weight goes to (from, to); what the weight gained enters from
    outside into ``to``, what it lost leaves from ``from``.
    """
    a, b = F.col(w1), F.col(w2)
    state_from, state_to = F.col(s1).cast("string"), F.col(s2).cast("string")
    stay = F.struct(state_from.alias("desde"), state_to.alias("hacia"), F.least(a, b).alias("monto"))
    move = F.struct(
        F.when(b > a, "Fuera").otherwise(state_from).alias("desde"),
        F.when(b > a, state_to).otherwise("Fuera").alias("hacia"),
        F.abs(b - a).alias("monto"),
    )
    parts = F.when(a == b, F.array(stay)).otherwise(F.array(stay, move))
    return (
        linked.select(F.explode(parts).alias("p"))
        .groupBy("p.desde", "p.hacia")
        .agg(F.sum("p.monto").alias("monto"))
    )


def net_and_gross(cells: DataFrame, value: str) -> DataFrame:
    """Per state: both margins, inflow, outflow and net change."""
    known = answered_both(cells)
    moved = F.col("state_1") != F.col("state_2")
    v = F.col(value)
    left = known.groupBy(F.col("state_1").alias("estado")).agg(
        F.sum(v).alias("margen_1"), F.sum(F.when(moved, v).otherwise(0)).alias("salidas")
    )
    came = known.groupBy(F.col("state_2").alias("estado")).agg(
        F.sum(v).alias("margen_2"), F.sum(F.when(moved, v).otherwise(0)).alias("entradas")
    )
    zero = F.lit(0)
    both = left.join(came, "estado", "full_outer")
    filled = both.select(
        "estado", *[F.coalesce(c, zero).alias(c) for c in ("margen_1", "margen_2", "entradas", "salidas")]
    )
    return filled.withColumn("cambio_neto", F.col("margen_2") - F.col("margen_1"))
