"""Last-writer-wins entries, maximum and multi-value registers, tag conflicts, observed frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import prefix


def latest(entries: DataFrame, keys: list[str], values: list[str], tag: Column) -> DataFrame:
    """The entry with the greatest tag of each key, with its tag. Partial aggregates travel, not entries."""
    found = entries.groupBy(*keys).agg(F.max(tag).alias("tag"), F.max_by(F.struct(*values), tag).alias("__v"))
    return found.select(*keys, "tag", *[F.col(f"__v.{v}").alias(v) for v in values])


def tag_conflicts(entries: DataFrame, tag: list[str], content: list[str]) -> DataFrame:
    """Tags under which different contents arrived: merging must fail on them, not pick one."""
    body = F.struct(*content)
    return entries.groupBy(*tag).agg(F.min(body).alias("a"), F.max(body).alias("b"), F.count("*").alias("n")).where("a <> b").drop("a", "b")


def observed_frontier(entries: DataFrame, tag: Column) -> DataFrame:
    """The greatest tag seen of each replica."""
    return entries.groupBy("replica").agg(F.max(tag).alias("tag"))


def multi_value(writes: DataFrame, contexts: DataFrame, obj: str = "obj") -> DataFrame:
    """Writes (obj, replica, ctr) that no context covers.

    contexts (obj, writer, replica, counter): up to which counter of a replica some write of another had seen. A write
    replaces all that it saw and, at its own replica, all before it.
    """
    seen = contexts.where("writer <> replica").groupBy(obj, "replica").agg(F.max("counter").alias("seen"))
    own = writes.groupBy(obj, "replica").agg(F.max("ctr").alias("ctr"))
    alive = own.join(seen, [obj, "replica"], "left").where(F.col("ctr") > F.coalesce("seen", F.lit(0))).select(obj, "replica", "ctr")
    return writes.join(alive, [obj, "replica", "ctr"], "left_semi")


def contexts_at_rounds(writes: DataFrame, every: int, obj: str = "obj") -> DataFrame:
    """Contexts of replicas that exchange all writes each time `every` operations are done."""
    by_round = writes.groupBy(obj, "replica", F.floor(F.col("op") / every).alias("round")).agg(F.max("ctr").alias("counter"))
    last = writes.groupBy(obj, F.col("replica").alias("writer")).agg(F.floor(F.max("op") / every).alias("upto"))
    known = by_round.join(last, obj).where(F.col("round") < F.col("upto"))
    return known.groupBy(obj, "writer", "replica").agg(F.max("counter").alias("counter"))


def running_clock(events: DataFrame, replica: str, order: str, physical: str) -> DataFrame:
    """Hybrid clock readings of local events: wall is the greatest physical time so far, logical counts within it."""
    walled = prefix(events, [replica], order, tops={"wall": F.col(physical)})
    return walled.withColumn("logical", F.row_number().over(Window.partitionBy(replica, "wall").orderBy(order)).cast("long") - 1)


def checked(entries: DataFrame, fits: Column) -> DataFrame:
    """entries with `ok`: whether the value is as its schema says; the others are for quarantine, not for readers."""
    return entries.withColumn("ok", F.coalesce(fits, F.lit(False)))


def dots(values: DataFrame, obj: str, value: str) -> DataFrame:
    """(obj, dots, v): a multi-value register's values in order of their dots, as text, and its value if it has just one."""
    rows = F.array_sort(F.collect_list(F.struct("replica", "ctr", value)))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["replica"], F.lit(":"), r["ctr"].cast("string"), F.lit("="), r[value].cast("string"))), ",")
    return values.groupBy(obj).agg(text.alias("dots"), F.when(F.count("*") == 1, F.max(value)).alias("v"))
