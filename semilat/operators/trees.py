"""Trees and version graphs: reachability level by level, or by doubled steps where graphs are deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored, walked


def below(nodes: DataFrame, level: DataFrame) -> DataFrame:
    """level(id, ...) joined with the nodes(id, parent, ...) right below: the columns of level are named __id and so on."""
    return level.select(*[F.col(c).alias(f"__{c}") for c in level.columns]).join(nodes, F.col("parent") == F.col("__id"))


def visible(nodes: DataFrame, tombs: DataFrame, levels: int = 100) -> DataFrame:
    """(id, depth) of nodes(id, parent) from the roots (null parent) down; a removed node hides its whole subtree."""
    kept = stored(nodes.join(tombs, "id", "left_anti").select("id", "parent"), "nodes")
    roots = kept.where("parent is null").select("id", F.lit(0).alias("depth"))
    return walked(roots, lambda live: below(kept, live).select("id", (F.col("__depth") + 1).alias("depth")), levels)


def ancestry(edges: DataFrame, heads: DataFrame, levels: int = 1000) -> DataFrame:
    """(head, id, distance): all versions that a head reaches over edges(id, parent), with the least distance.

    Each round doubles the steps: what lies less than 2n back, from what lies less than n back and steps of n, which are
    then joined with themselves. So the rounds grow with the logarithm of the longest chain.
    """
    steps = stored(edges.where("parent is not null").select("id", "parent").distinct(), "steps")
    seen, size = stored(heads.select(F.col("id").alias("head"), "id", F.lit(0).alias("distance")).distinct(), "seen"), 1
    while not steps.isEmpty():
        if size > levels:
            raise ValueError(f"more than {levels} levels: a cycle, or a deeper graph than allowed")
        one = steps.select(F.col("id").alias("__from"), F.col("parent").alias("__to"))
        beyond = seen.join(one, F.col("id") == F.col("__from")).select("head", F.col("__to").alias("id"), (F.col("distance") + size).alias("distance"))
        seen = stored(seen.unionAll(beyond).groupBy("head", "id").agg(F.min("distance").alias("distance")), "seen")
        steps = stored(steps.join(one, F.col("parent") == F.col("__from")).select("id", F.col("__to").alias("parent")).distinct(), "steps")
        size *= 2
    return seen


def paths(nodes: DataFrame, tag: str, digits: int = 9, levels: int = 100) -> DataFrame:
    """(id, path) of nodes(id, parent, tag): paths in order are the preorder with later siblings first."""
    held = stored(nodes.select("id", "parent", F.expr(f"lpad(cast({10**digits - 1} - {tag} as string), {digits}, '0')").alias("step")), "nodes")
    roots = held.where("parent is null").select("id", F.col("step").alias("path"))
    return walked(roots, lambda walk: below(held, walk).select("id", F.concat_ws("/", "__path", "step").alias("path")), levels)


def unreachable(nodes: DataFrame, levels: int = 100) -> DataFrame:
    """(id, problem) of nodes(id, parent) that no root reaches: below a missing parent they wait, else they hang on a cycle."""
    nodes = stored(nodes.select("id", "parent"), "nodes")
    have = nodes.select(F.col("id").alias("__have"))
    missing = nodes.where("parent is not null").join(have, F.col("parent") == F.col("__have"), "left_anti").select("id")
    reach = lambda start: walked(start, lambda seen: below(nodes, seen).select("id"), levels)
    fine = reach(nodes.where("parent is null").select("id")).select(F.col("id").alias("__seen"))
    late = reach(missing).select(F.col("id").alias("__late"))
    left = nodes.select("id").join(fine, F.col("id") == F.col("__seen"), "left_anti").join(late, F.col("id") == F.col("__late"), "left")
    return left.select("id", F.when(F.col("__late").isNotNull(), "waits").otherwise("cycle").alias("problem"))


def added(adds: DataFrame, live: DataFrame) -> DataFrame:
    """adds(id, parent) with `accepted`: whether the parent is a live node; others are rejected."""
    known = live.select(F.col("id").alias("__live"))
    return adds.join(known, F.col("parent") == F.col("__live"), "left").withColumn("accepted", F.col("__live").isNotNull()).drop("__live")
