"""Operation logs derived from the events table: the input that the convergent types aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import millis
from ..functions.windows import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str, replicas: int = 5) -> DataFrame:
    """op, replica, obj, elem, amt (cents), ms and ctr, the number of the operation at its replica."""
    events = table(spark, sf_dir, "events")
    log = events.select(
        F.col("event_id").alias("op"),
        F.concat(F.lit("r"), (F.col("user_id") % replicas).cast("string")).alias("replica"),
        F.col("event_type").alias("obj"),
        F.col("user_id").alias("elem"),
        F.round(F.col("value") * 100).cast("long").alias("amt"),
        millis("ts").alias("ms"),
    )
    return numbered(log, ["replica"], "op", "ctr")


def delivered(log: DataFrame, every: int = 3) -> DataFrame:
    """The log with every third operation delivered twice."""
    return log.unionAll(log.where(F.col("op") % every == 0))


def lossy(log: DataFrame, every: int = 17) -> DataFrame:
    """Deliveries of which every seventeenth operation is lost."""
    return delivered(log).where(F.col("op") % every != 0)
