"""Annual totals with covariances between months."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotapanel.functions.recode import joined
from rotapanel.operators.calibration import integrative
from rotapanel.operators.design import StratumCalibration, SurveyDesign
from rotapanel.operators.weights import annual_weights
from rotapanel.plans.quarterly import HOME, attach_household_weight, household_targets
from rotapanel.session import stored
from rotapanel.sources.microdata import MONTHS, QUARTERS


def household_sizes(people: DataFrame) -> DataFrame:
    """One row per household and quarter: weight of the representative and size.

    Size and representative come from one aggregate, not from a join.
    """
    rep = F.col("id_pers") == 1
    return (
        people.groupBy(*HOME, "estrato", "dam")
        .agg(F.count(F.lit(1)).alias("n_personas"), F.max(F.when(rep, F.col("dk_anual"))).alias("dk_anual"))
        .where(F.col("dk_anual").isNotNull())
    )


def calibrated_households(people: DataFrame, controls: DataFrame) -> DataFrame:
    homes = stored(household_sizes(people))  # grouped once, read for the sums and for the weights
    targets = household_targets(controls, "N_personas")
    return integrative(homes, "dk_anual", "n_personas", targets, "total", ["estrato"], "dk_anual_calib")


def calibrated_household_design(base: DataFrame, controls: DataFrame) -> SurveyDesign:
    homes = calibrated_households(annual_weights(base), controls)
    return SurveyDesign(homes, "dk_anual_calib", calibration=StratumCalibration("dk_anual", "n_personas"))


def annual_design(base: DataFrame, controls: DataFrame) -> SurveyDesign:
    """Persons with known activity and the annual calibrated weight, taken as a plain weight."""
    people = annual_weights(base)
    homes = calibrated_households(people, controls)
    weighted = attach_household_weight(people, homes, "dk_anual_calib").where(F.col("trabajo").isNotNull())
    weighted = weighted.withColumns(
        {"y": (F.col("trabajo") == "Desocupado").cast("int"), "trim_mes": joined("trimestre", "mes_trimestre")}
    )
    return SurveyDesign(weighted, "dk_anual_calib")


def month_by_outcome() -> dict[str, Column]:
    """Cells of the crossed factor month x outcome, 24 in all."""
    cells = {}
    for y in (0, 1):
        for q in QUARTERS:
            for m in MONTHS:
                cells[f"{q}_{m}.{y}"] = (F.col("trim_mes") == f"{q}_{m}") & (F.col("y") == y)
    return cells
