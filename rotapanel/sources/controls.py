"""Population control totals."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROLS_SCHEMA = "dam string, area string, N_hogares double, N_personas double"

# Households and persons represented by one customer.
HOUSEHOLDS_PER_CUSTOMER = 100.0
PERSONS_PER_CUSTOMER = 130.0


def derive_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household and person totals per stratum, from customers and nations."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_nationkey", F.when(F.col("c_custkey") % 8 < 5, "1").otherwise("2").alias("area")
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    counted = customers.groupBy("c_nationkey", "area").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(nations, counted.c_nationkey == nations.n_nationkey)
        .groupBy(F.col("n_regionkey").cast("string").alias("dam"), "area")
        .agg(
            (F.sum("n") * HOUSEHOLDS_PER_CUSTOMER).alias("N_hogares"),
            (F.sum("n") * PERSONS_PER_CUSTOMER).alias("N_personas"),
        )
    )


def write_controls_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_controls(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Controls from CSV (with a header) or Parquet, under the fixed schema."""
    reader = spark.read.schema(CONTROLS_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def control_terms(controls: DataFrame, total: str, prefix: str = "") -> DataFrame:
    """(term, total) rows: stratum label with an optional prefix, total rounded half to even."""
    return controls.select(
        F.concat(F.lit(prefix), F.concat_ws("_", "dam", "area")).alias("term"),
        F.bround(total, 0).alias("total"),
    )


def inline_controls(spark: SparkSession, totals: dict[str, float]) -> DataFrame:
    """Controls stated in the program, as (term, total) rows."""
    return spark.createDataFrame([(k, float(v)) for k, v in totals.items()], "term string, total double")
