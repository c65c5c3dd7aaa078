"""Person-by-quarter microdata: schema, derivation, contract and storage."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotapanel.session import join_small, settle, shared_dir

# The period and month codes of an annual survey file.
QUARTERS = ["T1", "T2", "T3", "T4"]
MONTHS = ["M1", "M2", "M3"]
ACTIVITY = ["Ocupado", "Desocupado", "Inactivo"]
SEXES = ["Hombre", "Mujer"]
POVERTY_LABELS = {1: "Pobreza extrema", 2: "Pobreza no extrema", 3: "Fuera de la pobreza"}
NO_ANSWER = "No responde"

MICRODATA_SCHEMA = T.StructType(
    [
        T.StructField("mes_trimestre", T.StringType(), False),
        T.StructField("estrato", T.StringType(), False),
        T.StructField("dam", T.StringType(), False),
        T.StructField("area", T.StringType(), False),
        T.StructField("upm", T.LongType(), False),
        T.StructField("id_hogar", T.LongType(), False),
        T.StructField("id_pers", T.IntegerType(), False),
        T.StructField("fep", T.DoubleType(), False),
        T.StructField("trabajo", T.StringType(), True),
        T.StructField("ingreso", T.DoubleType(), False),
        T.StructField("sexo", T.StringType(), False),
        T.StructField("etnia", T.StringType(), False),
        T.StructField("edad", T.IntegerType(), False),
        T.StructField("pobreza", T.IntegerType(), True),
        T.StructField("trimestre", T.StringType(), False),
    ]
)

# Rows of one household-quarter numbered by one task at most.
NUMBERING_SLICE = 1 << 20


def number_within(
    df: DataFrame, keys: list[str], order: str, carry: dict[str, Column], width: int = NUMBERING_SLICE
) -> DataFrame:
    """Add ``number`` (1, 2, …) by ``order`` inside ``keys``, plus group minima.

    ``order`` must be a unique integer. A group of up to ``width`` rows is numbered by
    one window. The rows of larger groups, whose short list is counted first, are
    numbered in slices of ``order`` and shifted by the sizes of the earlier slices, so
    a group that holds a large share of all rows is spread over many tasks.
    """
    def by_window(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        return rows.withColumns(
            {**{n: F.min(c).over(group) for n, c in carry.items()}, "number": F.row_number().over(group.orderBy(order)).cast("long")}
        )

    # Groups are counted together first, by a hash with room for about eight times their rows: only where such a
    # count passes the width are its groups counted one by one.
    places = max(4096, 8 * df.count() // width)
    place = F.expr(f"pmod(xxhash64({', '.join(keys)}), {places})")
    full = settle(df.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > width).select("_place"))
    if full.isEmpty():
        return by_window(df)
    suspects = join_small(df.withColumn("_place", place), full, ["_place"], "left_semi")
    large = settle(suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > width).select(*keys))
    if large.isEmpty():
        return by_window(df)
    rest = by_window(join_small(df, large, keys, "left_anti"))
    return rest.unionByName(_number_in_slices(join_small(df, large, keys, "left_semi"), keys, order, carry, width))


def _number_in_slices(df: DataFrame, keys: list[str], order: str, carry: dict[str, Column], width: int) -> DataFrame:
    sliced = df.withColumn("_slice", F.expr(f"`{order}` DIV {width}"))
    slice_keys = [*keys, "_slice"]
    sizes = sliced.groupBy(*slice_keys).agg(
        F.count(F.lit(1)).alias("_size"), *[F.min(c).alias(n) for n, c in carry.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shifts = sizes.select(
        *slice_keys,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"),
        *[F.min(n).over(whole).alias(n) for n in carry],
    )
    inner = Window.partitionBy(*slice_keys).orderBy(order)
    return (
        sliced.withColumn("_local", F.row_number().over(inner))
        .join(shifts, slice_keys)
        .withColumn("number", F.col("_local") + F.col("_shift"))
        .drop("_local", "_shift", "_slice")
    )


def derive_microdata(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Person-quarter rows from orders, customers and nations.

    An order is a person seen in a quarter, a customer is a household and
    (nation, customer modulo 8) is a primary sampling unit. All orders are
    used unless a single calendar ``year`` is asked for.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if year is not None:
        orders = orders.where(F.year("o_orderdate") == year)
    orders = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("c"),
        "o_orderstatus",
        "o_totalprice",
        F.quarter("o_orderdate").alias("q"),
        F.month("o_orderdate").alias("m"),
    )
    people = number_within(orders, ["c", "q"], "o_orderkey", {"month": F.col("m")})
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    people = people.join(customers, "c").join(nations, "n_nationkey")

    q, c, k = F.col("q"), F.col("c"), F.col("o_orderkey")
    person = F.col("number").cast("int")
    price = F.col("o_totalprice")
    dam = F.col("n_regionkey").cast("string")
    area = F.when(c % 8 < 5, "1").otherwise("2")
    unanswered = ((q == 1) & (k % 10 == 0)) | ((q > 1) & (k % 5 == 0))
    columns = {
        "mes_trimestre": F.concat(F.lit("M"), ((F.col("month") - 1) % 3 + 1).cast("string")),
        "estrato": F.concat_ws("_", dam, area),
        "dam": dam,
        "area": area,
        "upm": F.col("n_nationkey").cast("long") * 8 + c % 8,
        "id_hogar": c,
        "id_pers": person,
        "fep": (F.lit(50) + (c * 7 + q * 13) % 100).cast("double"),
        "trabajo": F.when(k % 20 != 0, state_of(F.col("o_orderstatus"))),
        "ingreso": price,
        "sexo": F.when((c + person) % 2 == 0, "Hombre").otherwise("Mujer"),
        "etnia": F.when(c % 7 == 0, "Indigena").when(c % 7 == 1, "Afro").otherwise("Otra"),
        "edad": (F.lit(15) + (c * 3 + person * 17) % 70).cast("int"),
        "pobreza": F.when(
            ~unanswered, F.when(price < 100000, 1).when(price < 250000, 2).otherwise(3)
        ),
        "trimestre": F.concat(F.lit("T"), q.cast("string")),
    }
    return people.select(*[expr.alias(name) for name, expr in columns.items()])


def state_of(status: Column) -> Column:
    return F.when(status == "F", "Ocupado").when(status == "P", "Desocupado").when(status == "O", "Inactivo")


def write_microdata(df: DataFrame, path: str) -> str:
    """Store microdata as Parquet with one folder per quarter."""
    df.write.mode("overwrite").partitionBy("trimestre").parquet(path)
    return path


def read_microdata(spark: SparkSession, path: str, quarters: list[str] | None = None) -> DataFrame:
    """Scan stored microdata; ``quarters`` prunes the folders that are read."""
    df = spark.read.schema(MICRODATA_SCHEMA).parquet(path)
    return df if quarters is None else df.where(F.col("trimestre").isin(quarters))


_stored: dict[tuple[str, str], str] = {}


def survey_base(spark: SparkSession, sf_dir: str, quarters: list[str] | None = None) -> DataFrame:
    """The annual file of one data folder, derived and stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
        path = f"{shared_dir(spark)}/rotapanel/{key[0]}/base_anual_{tag}"
        _stored[key] = write_microdata(derive_microdata(spark, sf_dir), path)
    return read_microdata(spark, _stored[key], quarters)


def contract_violations(df: DataFrame) -> DataFrame:
    """Count broken invariants, one row per rule, in one grouped pass each.

    Keys and weights are present, period codes are known, a household is
    visited in one month per quarter and carries one weight there, and a
    person appears once per quarter.
    """
    required = ["trimestre", "mes_trimestre", "estrato", "upm", "id_hogar", "id_pers", "fep"]
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in required])
    rows = df.agg(
        F.sum(missing).alias("missing_key_or_weight"),
        F.count_if(
            ~F.col("trimestre").isin(QUARTERS) | ~F.col("mes_trimestre").isin(MONTHS)
        ).alias("unknown_period"),
    )
    homes = (
        df.groupBy("trimestre", "id_hogar")
        .agg(
            F.min("mes_trimestre").alias("m0"),
            F.max("mes_trimestre").alias("m1"),
            F.min("fep").alias("w0"),
            F.max("fep").alias("w1"),
        )
        .agg(
            F.count_if(F.col("m0") != F.col("m1")).alias("household_in_two_months"),
            F.count_if(F.col("w0") != F.col("w1")).alias("household_with_two_weights"),
        )
    )
    persons = (
        df.groupBy("trimestre", "id_hogar", "id_pers")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("person_twice_in_quarter"))
    )
    out = None
    for table in (rows, homes, persons):
        rules = table.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("broken")) for c in table.columns])
            ).alias("r")
        ).select("r.*")
        out = rules if out is None else out.unionByName(rules)
    return out
