"""The durable log as tables: idempotent append, conflicts, replay and catch-up by state vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import numbered

DOT = ["replica", "ctr"]


def appended(arrivals: DataFrame, group: str, order: str, payload) -> DataFrame:
    """Arrivals without repeats of a dot, numbered by first arrival in their group, with the payload's digest.

    The first arrival of a dot is found by grouped aggregation, which combines repeats before the shuffle.
    """
    rest = [c for c in arrivals.columns if c not in (*DOT, group)]
    first = arrivals.groupBy(group, *DOT).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("__row"))
    rows = first.select(group, *DOT, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return numbered(rows, [group], order, "seq", tuple(DOT)).withColumn("digest", F.sha2(payload.cast("binary"), 256))


def dot_conflicts(arrivals: DataFrame, payload) -> DataFrame:
    """Dots that arrived with more than one payload."""
    found = arrivals.groupBy(*DOT).agg(F.min(payload).alias("least"), F.max(payload).alias("most"), F.count("*").alias("arrivals"))
    return found.where("least <> most").select(*DOT, "arrivals")


def replay(log: DataFrame, group: str, after: int, most: int | None = None) -> DataFrame:
    """Events after a sequence number. With `most`, all or an error: a group with more is never cut short."""
    rest = log.where(F.col("seq") > after)
    if most is None:
        return rest
    sizes = rest.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__size"))
    fits = F.assert_true(F.col("__size") <= most, F.lit("replay is larger than allowed"))
    return rest.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).withColumn("__fits", fits).where("__fits is null").drop("__fits", "__group", "__size")


def catch_up(log: DataFrame, vector: DataFrame) -> DataFrame:
    """Events whose dot the vector(replica, seen) does not cover."""
    return log.join(vector, "replica", "left").where(F.col("ctr") > F.coalesce("seen", F.lit(0))).drop("seen")
