"""Steps of operators that go through several large shuffles."""
from __future__ import annotations

from pyspark.sql import DataFrame

from rotapanel.session import stored

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Stores a step in the shared folder and lets Spark drop the shuffle files that made it."""
    conf = df.sparkSession.conf
    was = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        return stored(df)
    finally:
        conf.set(CLEAN, was)
