"""Pooled quarterly estimation: accumulated and calibrated weights."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotapanel.operators.calibration import poststratify
from rotapanel.operators.design import StratumCalibration, SurveyDesign
from rotapanel.operators.weights import or_fail, quarterly_weights, representatives
from rotapanel.session import join_small
from rotapanel.sources.controls import control_terms
from rotapanel.sources.microdata import MONTHS, QUARTERS

HOME = ["trimestre", "mes_trimestre", "upm", "id_hogar"]


def household_file(people: DataFrame, weight: str) -> DataFrame:
    """One row per household and quarter, with its accumulated weight."""
    return representatives(people).select(*HOME, "estrato", "dam", weight).distinct()


def household_targets(controls: DataFrame, total: str = "N_hogares") -> DataFrame:
    return control_terms(controls, total).withColumnRenamed("term", "estrato")


def calibrated_households(people: DataFrame, controls: DataFrame) -> DataFrame:
    """Households of every quarter calibrated to the stratum totals, all quarters in one job.

    A household has one representative per quarter, so the sums of weights
    are taken over representatives before the distinct projection.
    """
    homes = household_file(people, "dk_mes")
    targets = household_targets(controls)
    reps = representatives(people)
    return poststratify(
        homes, "dk_mes", targets, "total", ["estrato"], ["trimestre"], "dk_mes_cali", sums_from=reps
    )


def attach_household_weight(people: DataFrame, homes: DataFrame, weight: str, unmatched: str = "fail") -> DataFrame:
    """Give every person the weight of the household (join on the household key).

    Persons of a household without a weight (it has no representative) end the job, or
    with unmatched="keep" stay with a NULL weight.
    """
    joined = people.join(homes.select(*HOME, weight), HOME, "left")
    return joined.withColumn(weight, or_fail(F.col(weight), "a household has no representative", unmatched))


def calibration_factors(base: DataFrame, controls: DataFrame, weight: str = "fep") -> DataFrame:
    """Month share ``ai`` and calibration factor ``g`` per month and stratum.

    Both come from one grouped pass: the accumulated weight of a household is
    its month's share times its weight, so the sums of weights per month and
    stratum give the shares and the calibrated totals alike. The windows run
    over those sums, a few rows per stratum.
    """
    period = ["trimestre", "mes_trimestre"]
    known = F.col("trimestre").isin(QUARTERS) & F.col("mes_trimestre").isin(MONTHS)
    cells = base.where(known).groupBy(*period, "estrato").agg(
        F.sum(weight).alias("all"), F.sum(F.when(F.col("id_pers") == 1, F.col(weight))).alias("reps")
    )
    month, quarter = Window.partitionBy(*period), Window.partitionBy("trimestre")
    shares = cells.withColumn("ai", F.sum("all").over(month) / F.sum("all").over(quarter))
    have = F.sum(F.col("ai") * F.col("reps")).over(Window.partitionBy("trimestre", "estrato"))
    return shares.withColumn("have", have).join(household_targets(controls), "estrato", "left").select(
        *period, "estrato", "ai", F.try_divide(F.col("total"), F.col("have")).alias("g")
    )


def calibrated_persons(base: DataFrame, controls: DataFrame, weight: str = "fep", unmatched: str = "fail") -> DataFrame:
    """Persons with the accumulated and the calibrated weight of their household.

    The calibration factor depends on quarter and stratum only and the
    weight is constant inside a household, so persons take the factor itself.
    That joins a table of a few rows per stratum and leaves the microdata
    where it is, instead of shuffling it by household.
    """
    factors = calibration_factors(base, controls, weight)
    joined = join_small(base, factors, ["trimestre", "mes_trimestre", "estrato"], "left")
    share = or_fail(F.col("ai"), "a row has an unknown period code", unmatched)
    g = or_fail(F.col("g"), "a cell of the sample has no control total", unmatched)
    return joined.withColumn("dk_mes", F.col(weight) * share).withColumn("dk_mes_cali", F.col("dk_mes") * g).drop("g")


def quarterly_design(base: DataFrame, controls: DataFrame, quarters: list[str] | None = None) -> SurveyDesign:
    """Design on persons with calibrated weights taken as plain weights.

    ``quarters`` drops other rounds after weighting and before the design
    is declared.
    """
    people = calibrated_persons(base, controls)
    if quarters is not None:
        people = people.where(F.col("trimestre").isin(quarters))
    return SurveyDesign(people, "dk_mes_cali")


def household_design(base: DataFrame, controls: DataFrame, quarter: str) -> SurveyDesign:
    """Calibrated household design of one quarter, with residual variances."""
    homes = calibrated_households(quarterly_weights(base), controls).where(F.col("trimestre") == quarter)
    return SurveyDesign(homes, "dk_mes_cali", calibration=StratumCalibration("dk_mes"))
