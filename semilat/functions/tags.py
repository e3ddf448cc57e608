"""Mutation tags, dots and clock readings as Spark columns.

A tag is a struct whose fields stand in comparison order (wall, logical, replica), so that max, max_by and sort_array
order tags as the data model does; strings compare by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(wall, logical, replica) -> Column:
    return F.struct(F.col(wall).cast("long").alias("wall"), F.col(logical).cast("long").alias("logical"), F.col(replica).alias("replica"))


def dot(actor, counter) -> Column:
    return F.struct(F.col(actor).alias("actor"), F.col(counter).cast("long").alias("counter"))


def tag_valid(t: Column) -> Column:
    """A tag names its replica."""
    return F.coalesce(F.trim(t["replica"]) != "", F.lit(False))


def millis(ts) -> Column:
    """Milliseconds since 1970, rounded down, of a timestamp with or without a time zone (UTC)."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def covered(t: Column, frontier: Column) -> Column:
    """Whether a tag is not above its replica's frontier tag; null frontier: no."""
    return F.coalesce(t <= frontier, F.lit(False))
