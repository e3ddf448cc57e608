"""Recovery from a snapshot and deltas, differences since a base, and diagnostics rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recovered(snapshot: DataFrame, deltas: DataFrame, merge) -> DataFrame:
    """The state of a snapshot and deltas in any order, overlapping or repeated."""
    return merge(snapshot.unionByName(deltas.select(*snapshot.columns)))


def since(current: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the current state that are not in the base; the base must hold nothing that the current state lacks."""
    return current.join(base.select(*keys), keys, "left_anti")


def not_a_base(current: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a base that the current state lacks: with any, no difference can be taken."""
    return base.join(current.select(*keys), keys, "left_anti")


def diagnostics(kind: str, elements: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """One row: the type, its elements and its tombstones."""
    counted = elements.agg(F.count("*").alias("element_count")).select(F.lit(kind).alias("type"), "element_count")
    if tombstones is None:
        return counted.withColumn("tombstone_count", F.lit(0).cast("long"))
    return counted.crossJoin(tombstones.agg(F.count("*").alias("tombstone_count")))


def checkpoint(state: DataFrame, name: str, format: int, upto: int) -> DataFrame:
    """Rows(name, format, upto, obj, replica, component, digest) of a named checkpoint; the digest is over all its rows."""
    body = state.select("obj", "replica", "component")
    digest = body.agg(row_digest().alias("digest"))
    return body.join(digest, F.lit(True)).select(F.lit(name).alias("name"), F.lit(format).alias("format"), F.lit(upto).alias("upto"), "*")


def row_digest():
    """A digest of a set of rows that does not depend on their order and adds up over partitions."""
    return F.sum(F.xxhash64("obj", "replica", "component").cast("decimal(38,0)")).cast("string")


def latest_checkpoint(held: DataFrame, name: str, migrations: dict) -> DataFrame:
    """The newest checkpoint of a name that is whole and of a known format, brought to the newest one.

    migrations: for each format, the component as the newest format has it.
    """
    keys = ["format", "upto"]
    mine = held.where((F.col("name") == name) & F.col("format").isin(list(migrations)))
    whole = mine.groupBy(*keys).agg(row_digest().alias("found"), F.min("digest").alias("given")).where("found = given")
    newest = whole.agg(F.max(F.struct("upto", "format")).alias("n")).select("n.*")
    chosen = mine.join(newest, keys, "left_semi")
    moved = F.lit(None).cast("long")
    for format, move in migrations.items():
        moved = F.when(F.col("format") == format, move(F.col("component"))).otherwise(moved)
    return chosen.withColumn("component", moved)
