"""Session settings and the shared folder used to cut lineage."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables with more rows than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def build_session(cores: str | int = "*", app: str = "rotapanel") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since local disks are not shared.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rotapanel-"))
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a reduced table to the shared folder and go on from there.

    Used where a table far smaller than the microdata feeds several later
    steps, so that the microdata is scanned once and not once per step.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`settle` for a large table: Parquet, so later scans read only their columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rotapanel/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, dealt: bool = False) -> tuple[str, DataFrame]:
    """As :func:`stored`, one sorted file per bucket of ``keys``: such tables join on them without an exchange.

    Returns the table's name too, for :func:`drop_table`. ``dealt`` says that the rows
    already come from tables with the same buckets, and need no shuffle to be written.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    database = "rotapanel_" + re.sub(r"\W", "_", app)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_dir(spark)}/rotapanel/{app}/tables'")
    name = f"{database}.t{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name, spark.table(name)


def drop_table(spark: SparkSession, name: str | None) -> None:
    """Removes a table of :func:`bucketed` that later steps don't read any more."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a reduced table: broadcast it if its counted size allows.

    Beyond ``max_rows`` the join is left to Spark, which shuffles both sides
    and splits skewed partitions.
    """
    small = settle(small)
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; a NULL key is a group too. As :func:`join_small` for the size of ``groups``."""
    groups = settle(groups)
    if not keys:
        return rows.join(F.broadcast(groups), F.lit(True))  # one row
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    groups = groups.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return rows.join(groups, same, how).drop(*[f"_of_{c}" for c in keys])
