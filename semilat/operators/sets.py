"""Grow-only and observed-remove sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(incoming: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Elements of incoming that the state lacks; empty means that incoming adds nothing."""
    return incoming.select(*keys).distinct().join(state, keys, "left_anti")


def tombstones(log: DataFrame, removes, elem: str = "elem", replica: str = "replica") -> DataFrame:
    """Adds (their op is the tag) that a later remove of the same element at the same replica has observed.

    Only the last remove of an element at a replica matters, so that the join meets one row per key.
    """
    last = log.where(removes).groupBy(elem, replica).agg(F.max("op").alias("last"))
    return log.where(~removes).join(last, [elem, replica]).where(F.col("op") < F.col("last")).drop("last")


def live(adds: DataFrame, tombs: DataFrame, tag: str = "op") -> DataFrame:
    """Adds whose tag is not removed; a concurrent add, which no remove observed, stays."""
    return adds.join(tombs.select(tag).distinct(), tag, "left_anti")


def compactable(tombs: DataFrame, frontier: DataFrame) -> DataFrame:
    """Tombstones at or below their replica's frontier(replica, upto)."""
    return tombs.join(frontier, "replica").where(F.col("op") <= F.col("upto")).drop("upto")
