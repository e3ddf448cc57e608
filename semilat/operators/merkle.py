"""Digest inventories: leaves, roots by levels, and differences between two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest, uvarint

# Fixed values of the tree's hashing: prefixes of leaves, inner nodes and the empty tree.
LEAF, INNER, EMPTY = "00", "01", "02"


def leaves(entries: DataFrame, key: Column, value: Column, *extra: str) -> DataFrame:
    """(extra, key, digest, leaf): the value's digest, and the hash of key and digest, as lower-case hexadecimal."""
    rows = entries.select(*extra, key.alias("key"), digest(value).alias("__d"))
    framed = F.concat(F.unhex(F.lit(LEAF)), uvarint(F.octet_length("key")), F.col("key").cast("binary"), F.col("__d"))
    return rows.select(*extra, "key", F.lower(F.hex("__d")).alias("digest"), F.sha2(framed, 256).alias("leaf"))


def roots(hashed: DataFrame, tree: str) -> DataFrame:
    """(tree, root) of leaves (tree, key, leaf): levels of pairs, an odd last node being paired with zeros.

    One grouped aggregation a level, each half as large as the one before; a tree of n leaves takes log2(n) of them.
    """
    at = (F.row_number().over(Window.partitionBy(tree).orderBy("key")) - 1).cast("long")
    level = hashed.select(tree, at.alias("at"), F.unhex("leaf").alias("node"))
    most = hashed.groupBy(tree).count().agg(F.max("count")).first()[0] or 0
    zeros = F.unhex(F.lit("00" * 32))
    while most > 1:
        left = F.max(F.when(F.col("at") % 2 == 0, F.col("node"))).alias("l")
        right = F.max(F.when(F.col("at") % 2 == 1, F.col("node"))).alias("r")
        width = F.max("width").alias("w")
        sized = level.withColumn("width", F.col("at"))
        pairs = sized.groupBy(tree, F.shiftright("at", 1).alias("at")).agg(left, right, width)
        only = (F.col("at") == 0) & (F.count("*").over(Window.partitionBy(tree)) == 1) & F.col("r").isNull()
        joined = F.unhex(F.sha2(F.concat(F.unhex(F.lit(INNER)), F.col("l"), F.coalesce("r", zeros)), 256))
        level = pairs.select(tree, "at", F.when(only, F.col("l")).otherwise(joined).alias("node"))
        most = (most + 1) // 2
    return level.select(tree, F.lower(F.hex("node")).alias("root"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, side) of keys that only one side has or whose digests differ: left, right or different."""
    a, b = left.select("key", F.col("digest").alias("a")), right.select("key", F.col("digest").alias("b"))
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.col("a") != F.col("b"), "different")
    return a.join(b, "key", "full_outer").select("key", side.alias("side")).where("side is not null")


def repaired(left: DataFrame, right: DataFrame, keys: list[str], join) -> DataFrame:
    """Both sides after exchanging what differs: the union, merged by the type's own grouped join."""
    return join(left.unionByName(right), *keys)
