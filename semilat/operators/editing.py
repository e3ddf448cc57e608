"""Edits of replicated sequences as delta rows: inserts, deletes, moves, formats, editor transactions, undo.

placed(doc, id, ord) is a sequence in order, removed nodes included; `visible` says which are shown. Offsets count visible
nodes from 0 and are resolved once, when the edit is made: what leaves here are positions, which later edits don't shift.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored, walked
from .sequences import missing_parents


def offsets(placed: DataFrame, doc: str, visible: Column) -> DataFrame:
    """placed with __offset, the offset of each visible node, and __length of its sequence; removed nodes go."""
    shown = placed.where(visible)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("ord")).cast("long") - 1
    return shown.withColumn("__offset", place).withColumn("__length", F.count("*").over(Window.partitionBy(doc)))


def inserted(placed: DataFrame, edits: DataFrame, doc: str, visible: Column) -> DataFrame:
    """edits(doc, offset, ...) with `parent`, the node after which each inserts (null: the start), and `fits`: whether the
    offset is within the sequence. An edit that doesn't fit is rejected whole, never moved."""
    at = offsets(placed, doc, visible).select(F.col(doc).alias("__doc"), F.col("id").alias("parent"), "__offset")
    sizes = placed.where(visible).groupBy(F.col(doc).alias("__d")).agg(F.count("*").alias("__size"))
    held = edits.join(sizes, F.col(doc) == F.col("__d"), "left").withColumn("fits", F.col("offset").between(0, F.coalesce("__size", F.lit(0))))
    found = held.join(at, (F.col(doc) == F.col("__doc")) & (F.col("offset") - 1 == F.col("__offset")), "left")
    return found.withColumn("parent", F.when(F.col("fits"), F.col("parent"))).drop("__doc", "__offset", "__d", "__size")


def deleted(placed: DataFrame, edits: DataFrame, doc: str, visible: Column) -> DataFrame:
    """(doc, id) of the tombstones that edits(doc, offset, count) make; those beyond the end are left out whole."""
    at = offsets(placed, doc, visible)
    cut = edits.select(F.col(doc).alias("__doc"), "offset", "count")
    hit = (F.col(doc) == F.col("__doc")) & (F.col("__offset") >= F.col("offset")) & (F.col("__offset") < F.col("offset") + F.col("count")) & (F.col("offset") + F.col("count") <= F.col("__length"))
    return at.join(cut, hit).select(doc, "id").distinct()


def moved_order(placed: DataFrame, moves: DataFrame, doc: str, visible: Column) -> DataFrame:
    """(doc, id, place, before, changed) after moves(doc, from, count, to), one a sequence: `to` counts what is left when
    the range is out. `before` is the node that each now follows; `changed` are those whose placement the delta writes:
    the range, and what stands behind the first place that changes."""
    at = offsets(placed, doc, visible).join(moves.select(F.col(doc).alias("__doc"), F.col("from").alias("__from"), F.col("count").alias("__count"), F.col("to").alias("__to")), F.col(doc) == F.col("__doc"))
    inside = F.col("__offset").between(F.col("__from"), F.col("__from") + F.col("__count") - 1)
    rest = F.col("__offset") - F.when(F.col("__offset") >= F.col("__from") + F.col("__count"), F.col("__count")).otherwise(0)
    place = F.when(inside, F.col("__to") + F.col("__offset") - F.col("__from")).otherwise(rest + F.when(rest >= F.col("__to"), F.col("__count")).otherwise(0))
    new = at.withColumn("place", place)
    first = F.when(F.col("__from") == F.col("__to"), F.lit(None)).otherwise(F.least("__from", "__to"))
    return new.select(doc, "id", "place", F.lag("id").over(Window.partitionBy(doc).orderBy("place")).alias("before"), F.coalesce(F.col("place") >= first, F.lit(False)).alias("changed"))


def editor(operations: DataFrame, doc: str) -> DataFrame:
    """operations(doc, n, op, count, text) of one editor transaction a document, in order n, with `offset`: where each starts
    in the text before the transaction. Retained and deleted characters are passed; inserted ones are not."""
    passed = F.when(F.col("op") == "insert", 0).otherwise(F.col("count"))
    w = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return operations.withColumn("offset", F.coalesce(F.sum(passed).over(w), F.lit(0)))


def marked(placed: DataFrame, formats: DataFrame, doc: str) -> DataFrame:
    """(doc, id, key, tag, value) of the marks that formats(doc, offset, count, key, tag, value) put on exactly the visible
    nodes of their range when they are made; a null value removes the key."""
    at = offsets(placed, doc, F.lit(True)).select(F.col(doc).alias("__doc"), "id", "__offset")
    hit = (F.col(doc) == F.col("__doc")) & (F.col("__offset") >= F.col("offset")) & (F.col("__offset") < F.col("offset") + F.col("count"))
    return formats.join(at, hit).select(doc, "id", "key", "tag", "value")


def attributes(marks: DataFrame, doc: str) -> DataFrame:
    """(doc, id, attributes): the live marks of each node, the greatest tag of each key, as text in order of keys."""
    latest = marks.groupBy(doc, "id", "key").agg(F.max_by(F.struct("value"), "tag").alias("v")).where("v.value is not null")
    entry = F.concat("key", F.lit("="), F.col("v.value"))
    return latest.groupBy(doc, "id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("attributes"))


def undo(kinds: Iterable[str]) -> list[bool]:
    """Which of a session's commands are in effect at its end: `undo` takes back the last that is, `redo` the last taken
    back, and a new command forgets what could be redone. undo and redo themselves are never in effect."""
    kinds = list(kinds)
    done, gone, live = [], [], [False] * len(kinds)
    for n, kind in enumerate(kinds):
        if kind == "undo":
            if done:
                gone.append(done.pop())
        elif kind == "redo":
            if gone:
                done.append(gone.pop())
        else:
            done.append(n)
            gone = []
    for n in done:
        live[n] = True
    return live


def in_effect(commands: DataFrame, session: str, order: str, kind: Column) -> DataFrame:
    """(session, order, live) of commands: a session is one stack, so one group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return pd.DataFrame({session: rows[session], order: rows[order], "live": undo(rows["kind"])})

    chosen = commands.select(session, order, kind.alias("kind"))
    return chosen.groupBy(session).applyInPandas(one, f"{session} long, {order} long, live boolean")


def resolved(anchors: DataFrame, placed: DataFrame, doc: str, visible: Column) -> DataFrame:
    """anchors(doc, id) with `offset`, the visible nodes before the anchor's, and `gone`: its node is no longer kept. A
    removed node still holds its place."""
    before = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__rank", F.coalesce(F.sum(visible.cast("long")).over(before), F.lit(0)))
    kept = ranked.select(F.col(doc).alias("__doc"), F.col("id").alias("__id"), F.col("__rank").alias("offset"))
    return anchors.join(kept, (F.col(doc) == F.col("__doc")) & (F.col("id") == F.col("__id")), "left").withColumn("gone", F.col("__id").isNull()).drop("__doc", "__id")


def waiting(nodes: DataFrame, doc: str, levels: int = 1000) -> DataFrame:
    """Nodes that can't be placed yet: their parent, or an ancestor's, has not arrived."""
    nodes = stored(nodes.select(doc, "id", "parent"), "nodes")
    lost = missing_parents(nodes, doc).select(doc, "id")
    return walked(lost, lambda level: level.withColumnRenamed("id", "parent").join(nodes, [doc, "parent"]).select(doc, "id"), levels)


def collectable(nodes: DataFrame, doc: str, removable: Column, levels: int = 1000) -> DataFrame:
    """(doc, id) of removable nodes on which nothing hangs that stays: what peeling leaves, over and over, would take."""
    nodes = stored(nodes.select(doc, "id", "parent", removable.alias("__go")), "nodes")
    inner = nodes.where("__go and parent is not null")
    up = lambda level: level.join(inner, [doc, "id"]).select(doc, F.col("parent").alias("id")).distinct()
    held = walked(nodes.where("not __go and parent is not null").select(doc, F.col("parent").alias("id")).distinct(), up, levels)
    return nodes.where("__go").join(held, [doc, "id"], "left_anti").select(doc, "id")


def element(tag: str, attributes: dict[str, Column], inner: Column) -> Column:
    """An XML element as text, its attributes in order of names, special characters written as references."""
    named = [F.concat(F.lit(f' {n}="'), escaped(c), F.lit('"')) for n, c in sorted(attributes.items())]
    return F.concat(F.lit(f"<{tag}"), *named, F.lit(">"), inner, F.lit(f"</{tag}>"))


def escaped(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text
