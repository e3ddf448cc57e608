"""Tombstone collection: tags that every current member has acknowledged, and what may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import numbered

#: Acks counted in one part.
PART = 1 << 20


def stable(acks: DataFrame, members: DataFrame) -> DataFrame:
    """Tags acknowledged by all members of the current epoch (relational division). Acks of other epochs don't count.

    acks(epoch, member, tag), members(epoch, member). Tags are dealt into parts of about PART acks before they are counted:
    counting where the acks lie would keep a task's whole share of them.
    """
    newest = members.agg(F.max("epoch").alias("newest"))
    current = members.join(newest, members.epoch == newest.newest).select("epoch", "member").distinct()
    size = current.agg(F.count("*").alias("size"))
    parts = max(acks.sparkSession.sparkContext.defaultParallelism, acks.count() // PART + 1)
    dealt = acks.join(F.broadcast(current), ["epoch", "member"], "left_semi").repartition(parts, "tag")
    got = dealt.groupBy("tag").agg(F.count_distinct("member").alias("n"))
    return got.join(size, F.col("n") == F.col("size")).select("tag")


def collectable(tombs: DataFrame, acknowledged: DataFrame, keep: int = 0, most: int | None = None, group: str | None = None) -> DataFrame:
    """Acknowledged tombstones, oldest first within a group, all but the `keep` newest and at most `most`."""
    found = tombs.join(acknowledged, tombs.op == acknowledged.tag, "left_semi")
    if not keep and most is None:
        return found
    keys = [group] if group else []
    size = found.groupBy(*[F.col(k).alias("__key") for k in keys]).agg(F.count("*").alias("__n"))
    ranked = numbered(found, keys, "op", "__k").join(size, F.col(group).eqNullSafe(F.col("__key")) if group else F.lit(True))
    limit = F.col("__n") - keep
    return ranked.where(F.col("__k") <= (F.least(limit, F.lit(most)) if most is not None else limit)).drop("__k", "__n", "__key")


def unsafe(nodes: DataFrame, selected: DataFrame, scope: str) -> DataFrame:
    """Selected ids that may not go: a node that stays still hangs on them. Nothing is collected while there are any."""
    chosen = selected.select(scope, F.col("id").alias("__id"))
    stays = nodes.join(chosen, (nodes[scope] == chosen[scope]) & (nodes["id"] == chosen["__id"]), "left_anti")
    return selected.join(stays.select(scope, F.col("parent").alias("id")).distinct(), [scope, "id"], "left_semi")
