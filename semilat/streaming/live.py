"""Structured Streaming: live counters, the inbox, and presence.

Merging is idempotent, so a source that delivers more than once needs no deduplication, and late rows are joined whenever
they come: no result depends on event time. Streams are read from a folder of Parquet files in the shared folder; any
source with the same columns can stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stored import shared


def source(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """rows as a stream of a file in each micro-batch."""
    path = shared(spark, "stream")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, mode: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there."""
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", shared(spark, "offsets")).trigger(availableNow=True).foreachBatch(keep).start()
    started.awaitTermination()


def last_of(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The last row that an updating stream gave for each key."""
    path, schema = shared(spark, "sink"), T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    drained(spark, stream, mode, keep)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def counter_value(spark: SparkSession, deltas: DataFrame) -> DataFrame:
    """Live counters: a streaming maximum by component, whose updates are summed."""
    stream = source(spark, deltas.select("obj", "replica", "component"))
    live = stream.groupBy("obj", "replica").agg(F.max("component").alias("component"))
    return last_of(spark, live, "update", ["obj", "replica"]).groupBy("obj").agg(F.sum("component").alias("v"))


def merged(frontier: int, firsts: np.ndarray, lasts: np.ndarray, counters: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """advance() on arrays of the runs' ends."""
    new = np.unique(counters)
    new = new[new > frontier]
    first, last = np.concatenate([firsts, new]), np.concatenate([lasts, new])
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    gap = np.nonzero(first[1:] > last[:-1] + 1)[0]
    first, last = first[np.append(0, gap + 1)] if len(first) else first, np.append(last[gap], last[-1:])
    if len(first) and first[0] <= frontier + 1:
        frontier, first, last = max(frontier, int(last[0])), first[1:], last[1:]
    return frontier, first, last


def advance(frontier: int, waiting: list[tuple[int, int]], counters) -> tuple[int, list[tuple[int, int]]]:
    """The frontier after counters arrived in any order, and the runs (first, last) that wait beyond a gap.

    The frontier moves only over a gapless prefix. What waits is kept as runs: one lost counter leaves one of them.
    """
    ends = np.array(waiting, np.int64).reshape(-1, 2)
    frontier, first, last = merged(frontier, ends[:, 0], ends[:, 1], np.array(counters, np.int64))
    return frontier, list(zip(first.tolist(), last.tolist()))


def inbox(spark: SparkSession, arrivals: DataFrame) -> DataFrame:
    """(replica, frontier, pending): per-replica state of what was delivered without a gap and what waits.

    The state holds the runs' ends as the bytes of an array, 16 a run.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frontier, held = state.get if state.exists else (0, b"")
        ends = np.frombuffer(bytes(held), np.int64).reshape(2, -1)
        counters = np.concatenate([rows["ctr"].to_numpy(np.int64) for rows in batches])
        frontier, first, last = merged(frontier, ends[0], ends[1], counters)
        state.update((frontier, np.concatenate([first, last]).tobytes()))
        yield pd.DataFrame({"replica": [key[0]], "frontier": [frontier], "pending": [int((last - first + 1).sum())]})

    stream = source(spark, arrivals)
    found = stream.groupBy("replica").applyInPandasWithState(step, "replica string, frontier long, pending long", "frontier long, ends binary", "update", GroupStateTimeout.NoTimeout)
    return last_of(spark, found, "update", ["replica"])


def presence(spark: SparkSession, beats: DataFrame) -> DataFrame:
    """(actor, clock, state, seen): the beat with the greatest clock of each actor, live."""
    stream = source(spark, beats.select("actor", "clock", "state", "seen"))
    latest = stream.groupBy("actor").agg(F.max("clock").alias("clock"), F.max_by(F.struct("state", "seen"), "clock").alias("v"))
    return last_of(spark, latest, "update", ["actor"]).select("actor", "clock", "v.*")
