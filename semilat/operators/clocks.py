"""Hybrid clocks that witness remote tags, and their state over restarts, as running maxima; `fold` is the rule itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import prefix


def fold(steps: Iterable[tuple[int, int | None, int | None]]) -> list[tuple[int, int]]:
    """(wall, logical) after each step (physical time, witnessed wall, witnessed logical); local steps witness None."""
    wall = logical = 0
    out = []
    for physical, seen, count in steps:
        top = max(wall, physical, seen if seen is not None else 0)
        if top == wall and seen is not None and top == seen:
            logical = max(logical, count) + 1
        elif top == wall:
            logical += 1
        elif seen is not None and top == seen:
            logical = count + 1
        else:
            logical = 0
        wall = top
        out.append((wall, logical))
    return out


def witnessed(events: DataFrame, replica: str, order: str, physical: str, wall: str, logical: str) -> DataFrame:
    """(replica, order, wall, logical): readings of each replica's local and receiving events.

    wall is a running maximum. While it stands still each event adds one to logical, and a witnessed tag of that wall lifts
    it above its own: so logical is the greatest lift so far, plus the events since. Order numbers events without gaps.
    """
    seen = events.select(replica, order, physical, F.col(wall).alias("__wall"), F.col(logical).alias("__logical"))
    walled = prefix(seen, [replica], order, tops={"wall": F.greatest(F.lit(0).cast("long"), physical, "__wall")})
    first = F.row_number().over(Window.partitionBy(replica, "wall").orderBy(order)) == 1
    lift = F.greatest(F.when(first, F.when(F.col("wall") > 0, 0).otherwise(1)), F.when(F.col("__wall") == F.col("wall"), F.col("__logical") + 1)).cast("long")
    lifted = prefix(walled.withColumn("__lift", lift - F.col(order)), [replica, "wall"], order, tops={"__top": F.col("__lift")})
    return lifted.select(replica, F.col(order).cast("long").alias(order), "wall", (F.col("__top") + F.col(order)).alias("logical"))


def restored(readings: DataFrame, replica: str) -> DataFrame:
    """(replica, wall, logical): the clock to go on from, above every reading that the replica gave or saw."""
    return readings.groupBy(replica).agg(F.max(F.struct("wall", "logical")).alias("t")).select(replica, "t.wall", "t.logical")


def resumed(events: DataFrame, states: DataFrame, replica: str, order: str, physical: str) -> DataFrame:
    """(replica, order, wall, logical) of local events after a restart from states(replica, wall, logical)."""
    known = events.join(states.select(F.col(replica).alias("__r"), F.col("wall").alias("__w"), F.col("logical").alias("__l")), F.col(replica) == F.col("__r"), "left")
    walled = prefix(known, [replica], order, tops={"wall": F.greatest(F.coalesce("__w", F.lit(0)), physical)})
    place = F.row_number().over(Window.partitionBy(replica, "wall").orderBy(order)).cast("long")
    return walled.select(replica, order, "wall", F.when(F.col("wall") == F.col("__w"), F.col("__l") + place).otherwise(place - 1).alias("logical"))
