"""Helpers shared by the training-data operators: durable intermediates, Arrow maps, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word as the contracts define it: what is not ASCII white space. bytes.split() splits on the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one is set only where the session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp()}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame, kind: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing already done."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what durable() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drawn(rows: DataFrame, count: int) -> DataFrame:
    """About `count` distinct rows, those whose hash over all columns is small; all distinct rows of a table of up to `count`.

    A bound on the hash, from the number of rows, picks them where they lie: no task sends candidates to the driver.
    """
    n = rows.count()
    if n > count:
        rows = rows.where(F.xxhash64(*rows.columns) < -(2**63) + 2**64 * count // n)
    return rows.distinct()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links left[i]-right[i]."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots hang on smaller roots
        while (label[label] != label).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of edges(a, b) reaches. Empty edges give an empty result.

    In each round every node hangs on its smallest neighbour, these steps are followed up to their ends, and only links
    between different ends go on, as links of the ends: a link within what is joined already is not met again. Each round
    is written to the shared folder. Both sides of each join are plain scans, so that Spark can split a hub's rows.
    """

    def apart(links: DataFrame) -> DataFrame:
        return durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    links, labels = apart(edges), None
    while True:
        ends = links.union(links.select("b", "a"))
        top = to_the_ends(durable(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels"))
        left = durable(links.join(top, links.a == top.node).select(F.col("component").alias("a"), "b"), "edges")
        rest = apart(left.join(top, left.b == top.node).select("a", F.col("component").alias("b")))
        if labels is None:
            labels = top
        else:
            up = top.select(F.col("node").alias("at"), F.col("component").alias("top"))
            after = durable(labels.join(up, labels.component == up["at"], "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
            forget(labels)
            forget(top)
            labels = after
        forget(left)
        forget(links)
        if rest.isEmpty():
            return labels
        links = rest


def to_the_ends(labels: DataFrame) -> DataFrame:
    """(node, component): labels with each component replaced by its own, until nothing changes."""
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total or now is None:
            return labels
        total = now
        up = labels.select(F.col("node").alias("below"), F.col("component").alias("at"))
        after = durable(up.join(labels, up["at"] == labels.node).select(F.col("below").alias("node"), "component"), "labels")
        forget(labels)
        labels = after
