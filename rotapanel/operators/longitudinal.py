"""Two-period panel files and their weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.reshape import to_wide
from rotapanel.operators.overlap import seen_in_all

PERSON = ["id_hogar", "id_pers"]


def households(df: DataFrame, weight: str = "fep") -> DataFrame:
    """One row per household and quarter."""
    return df.select("upm", "trimestre", "id_hogar", weight).distinct()


def household_flags(df: DataFrame, first: str, second: str, weight: str = "fep") -> DataFrame:
    """Per household: seen in both quarters, and its weight in the first.

    One grouped pass gives the flag and the first-quarter weight; households
    not seen in the first quarter are left out.
    """
    q = F.col("trimestre")
    return (
        df.where(q.isin(first, second))
        .groupBy("id_hogar")
        .agg(
            F.max(F.when(q == first, F.col(weight))).alias("fep_t1"),
            F.max((q == second).cast("int")).alias("respboth"),
        )
        .where(F.col("fep_t1").isNotNull())
    )


def household_panel(df: DataFrame, first: str, second: str, weight: str = "fep") -> DataFrame:
    """Household-quarter rows with the response flag and first-quarter weight."""
    rows = households(df.where(F.col("trimestre").isin(first, second)), weight)
    return rows.join(household_flags(df, first, second, weight), "id_hogar")


def basic_weight(probability: float, flag: str = "respboth", weight: str = "fep_t1") -> Column:
    """First-period weight over the chance that the panel stays, 0 if not seen twice."""
    return F.when(F.col(flag) == 1, F.col(weight) / F.lit(float(probability))).otherwise(0.0)


def persons_of_panel(df: DataFrame, first: str, second: str) -> DataFrame:
    """Person-quarter rows of households seen in both quarters."""
    both = seen_in_all(df, ["id_hogar"], [first, second])
    return df.where(F.col("trimestre").isin(first, second)).join(both, "id_hogar", "left_semi")


def with_person_flag(people: DataFrame, first: str, second: str, name: str = "respboth_per") -> DataFrame:
    """1 where the person, keyed by household and number, is seen in both quarters."""
    ids = seen_in_all(people, PERSON, [first, second]).withColumn(name, F.lit(1))
    return people.join(ids, PERSON, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_household_weight(people: DataFrame, panel: DataFrame, weight: str = "fep_long") -> DataFrame:
    return people.join(panel.select("id_hogar", "trimestre", weight), ["id_hogar", "trimestre"])


def person_panel(df: DataFrame, first: str, second: str, probability: float, weight: str = "fep") -> DataFrame:
    """Person-quarter rows of panel households with flag and basic weight.

    Presence and first-quarter weight are aggregated per person and from
    there per household; the rows are then joined once, on the person.
    """
    rows = df.where(F.col("trimestre").isin(first, second))
    q = F.col("trimestre")
    persons = rows.groupBy(*PERSON).agg(
        F.max(q == first).alias("in_1"),
        F.max(q == second).alias("in_2"),
        F.max(F.when(q == first, F.col(weight))).alias("fep_t1"),
    )
    homes = persons.groupBy("id_hogar").agg(
        F.max("fep_t1").alias("fep_t1"), F.max("in_1").alias("h_1"), F.max("in_2").alias("h_2")
    )
    both = homes.where("h_1 and h_2").select("id_hogar", (F.col("fep_t1") / F.lit(float(probability))).alias("fep_long"))
    flags = persons.join(both, "id_hogar").select(
        *PERSON, (F.col("in_1") & F.col("in_2")).cast("int").alias("respboth_per"), "fep_long"
    )
    return rows.join(flags, PERSON)


def linked(people: DataFrame, first: str, second: str, at_first: dict[str, str], at_second: dict[str, str]) -> DataFrame:
    """One row per person seen in both quarters, with columns of each quarter.

    ``at_first`` and ``at_second`` map new names to columns. One aggregate
    per person takes the place of a self-join.
    """
    q = F.col("trimestre")
    wide = people.where(q.isin(first, second)).groupBy(*PERSON).agg(
        F.max(q == first).alias("_in1"),
        F.max(q == second).alias("_in2"),
        *[F.max(F.when(q == first, F.col(c))).alias(n) for n, c in at_first.items()],
        *[F.max(F.when(q == second, F.col(c))).alias(n) for n, c in at_second.items()],
    )
    return wide.where("_in1 and _in2").drop("_in1", "_in2")


def mean_response_rate(people: DataFrame, by: list[str] | None = None, flag: str = "respboth_per") -> DataFrame:
    """Mean response rate, overall or per group, used where no covariates exist."""
    return people.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("prob_resp")
    )


def adjusted_weight(weight: str = "fep_long", probability: str = "prob_resp") -> Column:
    return F.try_divide(F.col(weight), F.col(probability))


def zero_for_nonresponse(weight: str, flag: str) -> Column:
    return F.when(F.col(flag) == 1, F.col(weight)).otherwise(0.0)


def weight_of_newcomers(people: DataFrame, weight: str) -> DataFrame:
    """Persons without a weight take their household's.

    The household weight is aggregated before the join, not windowed over
    the members.
    """
    homes = people.groupBy("id_hogar").agg(F.max(weight).alias("_home"))
    return people.join(homes, "id_hogar").withColumn(weight, F.coalesce(weight, "_home")).drop("_home")


def wide_states(people: DataFrame, state: str, quarters: list[str]) -> DataFrame:
    """One row per person with the state in each quarter; absent stays NULL."""
    wide = to_wide(people, PERSON, "trimestre", F.first(state), quarters)
    return wide.withColumnsRenamed({q: f"{state}_{q.lower()}" for q in quarters})


def longitudinal_base(
    people: DataFrame, state: str, first: str, second: str, attributes: list[str]
) -> DataFrame:
    """One row per person seen twice: first-quarter attributes and both states.

    A single aggregate per person replaces the distinct projection and the
    self-join, and cannot give two rows when an attribute changes.
    """
    q = F.col("trimestre")
    return people.groupBy(*PERSON).agg(
        *[F.max(F.when(q == first, F.col(a))).alias(a) for a in attributes],
        F.max(F.when(q == first, F.col(state))).alias(f"{state}_t1"),
        F.max(F.when(q == second, F.col(state))).alias(f"{state}_t2"),
    )


def without_exits(people: DataFrame, exits: DataFrame) -> DataFrame:
    """Leave out persons who left the population between the rounds."""
    return people.join(exits.select(*PERSON), PERSON, "left_anti")
