"""Two-period longitudinal weights and the flow analysis built on them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotapanel.operators.calibration import poststratify
from rotapanel.operators.design import StratumCalibration, SurveyDesign
from rotapanel.operators.longitudinal import adjusted_weight, longitudinal_base, mean_response_rate, person_panel
from rotapanel.operators.propensity import fit_response, predict_response
from rotapanel.plans.quarterly import household_targets
from rotapanel.session import join_small, stored

ATTRIBUTES = ["upm", "estrato", "edad", "sexo", "area", "fep_aj"]


def scored_panel(
    base: DataFrame,
    probability: float,
    covariates: list[str] | None = None,
    first: str = "T1",
    second: str = "T2",
) -> DataFrame:
    """Person-quarter rows of the panel with ``prob_resp`` and ``fep_aj``.

    The propensity is a logit on the covariates, or the mean response rate
    of the stratum when there are none. The linked rows are written once:
    the fit, the scores and the final file all read them.
    """
    people = stored(person_panel(base, first, second, probability))
    if covariates:
        model = fit_response(people, "respboth_per", covariates)
        scored = predict_response(model, people, covariates)
    else:
        rates = mean_response_rate(people, ["estrato"]).drop("n")
        scored = join_small(people, rates, ["estrato"])
    return scored.withColumn("fep_aj", adjusted_weight())


def final_base(scored: DataFrame, controls: DataFrame, state: str, first: str = "T1", second: str = "T2") -> DataFrame:
    """One row per person seen twice, calibrated to person totals per stratum.

    A person seen twice has one row in the first quarter, so the weights per
    stratum are summed there, without grouping persons first.
    """
    both = scored.where(F.col("respboth_per") == 1)
    rows = longitudinal_base(both, state, first, second, ATTRIBUTES)
    firsts = both.where(F.col("trimestre") == first)
    targets = household_targets(controls, "N_personas")
    return poststratify(rows, "fep_aj", targets, "total", ["estrato"], name="fex_cali", sums_from=firsts)


def panel_design(final: DataFrame, residual: bool = False) -> SurveyDesign:
    """Design of the longitudinal file; ``residual`` uses calibration residuals."""
    cal = StratumCalibration("fep_aj") if residual else None
    return SurveyDesign(final, "fex_cali", nest=False, lonely_psu="certainty", calibration=cal)


def store_final(final: DataFrame, path: str) -> DataFrame:
    """Write the longitudinal file and go on from the stored copy."""
    final.write.mode("overwrite").parquet(path)
    return final.sparkSession.read.schema(final.schema).parquet(path)


def reload_final(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
