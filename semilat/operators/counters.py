"""Grow-only and up-down counters: a replica's component only grows, so merging is a maximum and reading is a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import prefix


def deltas(log: DataFrame, obj: str, amount: str) -> DataFrame:
    """The log as deltas (obj, replica, op, component): each carries its replica's new total."""
    rows = log.select(F.col(obj).alias("obj"), "replica", "op", F.col(amount).alias("__amount"))
    return prefix(rows, ["obj", "replica"], "op", {"component": F.col("__amount")}).drop("__amount")


def merged(components: DataFrame, *keys: str) -> DataFrame:
    """The least state that contains all deltas or states: the greatest component of each replica."""
    return components.groupBy(*(keys or ("obj", "replica"))).agg(F.max("component").alias("component"))


def value(state: DataFrame) -> DataFrame:
    return state.groupBy("obj").agg(F.sum("component").alias("v"))


def changed(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming components beside the state's, and whether they extend it."""
    old = state.select("obj", "replica", F.col("component").alias("old"))
    return incoming.join(old, ["obj", "replica"], "left").select("obj", "replica", "component", F.coalesce("old", F.lit(0)).alias("old"), (F.col("component") > F.coalesce("old", F.lit(0))).alias("changed"))


def signed_value(components: DataFrame, obj: str) -> DataFrame:
    """Value of up-down counters from deltas (obj, replica, sign, component), sign +1 or -1."""
    state = components.groupBy(obj, "replica", "sign").agg(F.max("component").alias("component"))
    return state.groupBy(obj).agg(F.sum(F.col("sign") * F.col("component")).alias("v"))


def bounded(state: DataFrame, most: int) -> DataFrame:
    """(obj, v, overflow): the value, or null where it is beyond what its type holds."""
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    return state.groupBy("obj").agg(F.when(total <= most, total.cast("long")).alias("v"), (total > most).alias("overflow"))
