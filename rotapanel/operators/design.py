"""Survey design: metadata over a lazy DataFrame."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StratumCalibration:
    """Weights were calibrated to one total per stratum, from ``base`` weights.

    ``size`` is the calibration variable (1 for plain counts).
    """

    base: str
    size: str | None = None


@dataclass(frozen=True)
class MarginCalibration:
    """Weights were calibrated on 0/1 or numeric ``terms``, from ``base`` weights."""

    base: str
    terms: dict[str, Column]


@dataclass(frozen=True)
class SurveyDesign:
    """Data with its primary sampling units, strata and weights.

    ``nest`` makes the unit key (stratum, unit); without it a unit code must
    stay inside one stratum. ``lonely_psu`` is "fail" or "certainty".
    """

    df: DataFrame
    weight: str
    psu: str = "upm"
    strata: str = "estrato"
    nest: bool = True
    lonely_psu: str = "fail"
    domain: Column | None = None
    calibration: StratumCalibration | MarginCalibration | None = None

    def where(self, condition: Column) -> SurveyDesign:
        """Restrict to a domain; units outside it still count in their strata."""
        both = condition if self.domain is None else self.domain & condition
        return replace(self, domain=both)

    def subset(self, condition: Column) -> SurveyDesign:
        """Drop the other rows and declare the design on what is left."""
        return replace(self, df=self.df.where(condition))

    def mutate(self, **columns: Column) -> SurveyDesign:
        return replace(self, df=self.df.withColumns(columns))

    def plain(self) -> SurveyDesign:
        """Treat calibrated weights as if they were design weights."""
        return replace(self, calibration=None)

    @property
    def inside(self) -> Column:
        return F.lit(True) if self.domain is None else F.coalesce(self.domain, F.lit(False))

    def units(self) -> DataFrame:
        """(stratum, unit) pairs of the whole design."""
        return self.df.select(self.strata, self.psu).distinct()

    def strata_sizes(self) -> DataFrame:
        return self.units().groupBy(self.strata).agg(F.count(F.lit(1)).alias("n_psu"))

    def units_in_several_strata(self) -> DataFrame:
        return (
            self.units()
            .groupBy(self.psu)
            .agg(F.count(F.lit(1)).alias("n_strata"))
            .where(F.col("n_strata") > 1)
        )

    def check_units(self) -> SurveyDesign:
        """Without ``nest``, refuse unit codes shared between strata."""
        if not self.nest and self.units_in_several_strata().limit(1).count():
            raise ValueError("a primary sampling unit appears in more than one stratum")
        return self

    def lonely_factor(self, n: Column, whenmany: Column) -> Column:
        """``whenmany`` for strata of several units, else what the policy says."""
        if self.lonely_psu == "certainty":
            alone = F.lit(0.0)
        else:
            alone = F.raise_error(F.lit("a stratum has a single primary sampling unit")).cast("double")
        return F.when(n > 1, whenmany).otherwise(alone)
