"""Delivery state: contiguous frontiers, pending and duplicate arrivals, runs of counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import numbered as places


def numbered(arrivals: DataFrame) -> DataFrame:
    """Distinct dots with their rank at their replica: the gapless prefix is where counter and rank agree."""
    return places(arrivals.select("replica", "ctr").distinct(), ["replica"], "ctr", "rank")


def frontier(arrivals: DataFrame) -> DataFrame:
    """(replica, frontier, pending): the last counter delivered without a gap, and how many wait beyond it."""
    whole = F.col("ctr") == F.col("rank")
    return numbered(arrivals).groupBy("replica").agg(F.coalesce(F.max(F.when(whole, F.col("ctr"))), F.lit(0)).alias("frontier"), F.count_if(~whole).alias("pending"))


def waiting(arrivals: DataFrame) -> DataFrame:
    """Dots that arrived but wait for an earlier one."""
    return numbered(arrivals).where("ctr <> rank").select("replica", "ctr")


def repeats(arrivals: DataFrame) -> DataFrame:
    """Dots that arrived more than once, and how often too many."""
    return arrivals.groupBy("replica", "ctr").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def runs(arrivals: DataFrame) -> DataFrame:
    """Maximal runs of consecutive counters (replica, first, length): the run-length form of a set of dots."""
    island = numbered(arrivals).withColumn("island", F.col("ctr") - F.col("rank"))
    return island.groupBy("replica", "island").agg(F.min("ctr").alias("first"), F.count("*").alias("length")).drop("island")
