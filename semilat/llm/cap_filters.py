"""Near-duplicate embeddings by spherical-cap filters.

Filters are directions of a random product code: the space is cut into two blocks, each with CODEWORDS random unit
vectors, and every pair of codewords is a filter. List decoding finds the LISTED filters closest to a vector, its cap,
from the best codewords of each block without looking at all pairs of codewords. Vectors that share a label, a length and
a filter are candidates; their cosine is then computed in double precision.

A vector is sent once for each of its distinct first codewords, with all its filters. Where a label and codeword have
more than TILE vectors, they are dealt into tiles and each pair of tiles is compared. A pair of vectors counts only at
the first of the codewords at which they share a filter. What leaves a comparison is, for each vector, how many others it
links to and the root of its links in a spanning forest: never the pairs themselves. Equal vectors are compared once.

A cap is the LISTED closest filters, not all beyond a fixed threshold: halves of unlike length would otherwise leave some
vectors with hardly any filter and others with thousands. The caps are found at random: at a cosine of 0.93 and 64 dimensions a pair is missed less than once in a thousand times,
and far more rarely above (tests measure it against brute force).

Nulls: vectors that are null, empty or zero or hold null or non-finite components, and rows with a null label, link with
nothing. A row with a null id links like others but gives its component no name; one of only such rows has a null
component. Repeated rows link with each other. Rows with one id share its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable, forget, roots

CODEWORDS, LISTED, TILE, SEED = 512, 48, 2048, 93


def codes(dim: int, codewords: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks' unit codewords, the same in every task."""
    rng, half = np.random.default_rng([seed, dim, codewords]), (dim + 1) // 2
    blocks = rng.standard_normal((codewords, half)), rng.standard_normal((codewords, dim - half))
    return tuple(b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for b in blocks)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_decode(x: np.ndarray, codewords: int, listed: int) -> np.ndarray:
    """For each unit vector the `listed` filters with the largest products, sorted by number."""
    first, second = codes(x.shape[1], codewords)
    half, most = first.shape[1], min(listed, codewords)
    ranked = []
    for part, code in ((x[:, :half], first), (x[:, half:], second)):
        product = part @ code.T
        best = np.argsort(-product, axis=1, kind="stable")[:, :most]
        ranked.append((best, np.take_along_axis(product, best, 1)))
    # The pair of ranks (a, b) is beaten by (a + 1)(b + 1) - 1 others at least.
    a, b = np.array([(a, b) for a in range(most) for b in range(most) if (a + 1) * (b + 1) <= listed]).T
    sums = ranked[0][1][:, a] + ranked[1][1][:, b]
    top = np.argsort(-sums, axis=1, kind="stable")[:, :listed]
    return np.sort(np.take_along_axis(ranked[0][0][:, a] * codewords + ranked[1][0][:, b], top, 1), axis=1).astype(np.int32)


def sent(batch: pa.RecordBatch, kind: str, codewords: int, listed: int):
    """A row for each of a vector's first codewords."""
    columns = {n: batch.column(n) for n in ("node", "group", "copies")}
    vectors = [np.array(v, kind) for v in batch.column("embedding").to_pylist()]
    sizes = np.array([len(v) for v in vectors])
    for dim in np.unique(sizes):
        rows = np.nonzero(sizes == dim)[0]
        x = np.stack([vectors[r] for r in rows])
        filters = list_decode(unit(x), codewords, listed)
        heads = filters // codewords
        new = np.ones(heads.shape, bool)
        new[:, 1:] = heads[:, 1:] != heads[:, :-1]
        at, place = np.nonzero(new)
        source = pa.array(rows[at])
        out = {n: c.take(source) for n, c in columns.items()}
        out |= {"dim": pa.array(np.full(len(at), dim), pa.int32()), "head": pa.array(heads[at, place], pa.int32()), "vector": pa.array([x[i].tobytes() for i in at], pa.binary()), "filters": pa.array([filters[i].tobytes() for i in at], pa.binary())}
        yield pa.RecordBatch.from_pydict(out)


def linked(table: pa.Table, kind: str, codewords: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links, root row) of the rows of a tile or pair of tiles that link with others here for the first time."""
    side, copies = table["side"].to_numpy(), table["copies"].to_numpy()
    head = table["head"][0].as_py()
    x = unit(np.stack([np.frombuffer(v.as_py(), kind) for v in table["vector"]]))
    filters = np.stack([np.frombuffer(v.as_py(), np.int32) for v in table["filters"]])
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    same = table["one"][0].as_py()
    if same:
        right = left
    close = x[left] @ x[right].T >= least
    if same:
        close[np.tril_indices(len(left))] = False
    i, j = np.nonzero(close)
    i, j = left[i], right[j]
    rows = np.unique(np.concatenate([i, j]))
    if len(rows):
        own = filters[rows]
        place = np.full(len(x), -1)
        place[rows] = np.arange(len(rows))
        here = shared(own, own // codewords == head)[place[i], place[j]]
        before = shared(own, own // codewords < head)[place[i], place[j]]
        i, j = i[here & ~before], j[here & ~before]
    links = np.zeros(len(x), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    rows = np.nonzero(links)[0]
    return rows, links[rows], roots(len(x), i, j)[rows]


def shared(filters: np.ndarray, counted: np.ndarray, width: int = 2048) -> np.ndarray:
    """Which rows share one of their counted filters."""
    values, at = np.unique(filters[counted], return_inverse=True)
    row, out = np.nonzero(counted)[0], np.zeros((len(filters), len(filters)), bool)
    often = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, at = row[often[at]], number[at[often[at]]]
    for start in range(0, int(often.sum()), width):
        now = (at >= start) & (at < start + width)
        block = np.zeros((len(filters), width), np.float32)
        block[row[now], at[now] - start] = 1
        out |= block @ block.T > 0.5
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, codewords: int = CODEWORDS, listed: int = LISTED, tile: int = TILE) -> DataFrame:
    """(id, n_links, component) of each row."""
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    v, inf = F.col("embedding"), float("inf")
    fine = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumns({"fine": F.coalesce(fine, F.lit(False)), "k1": F.xxhash64("label", v), "k2": F.xxhash64(F.lit(SEED), v, "label")})
    rows = durable(rows, "vectors")
    distinct = rows.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("name"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = durable(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def decode(batches):
        for batch in batches:
            yield from sent(batch, kind, codewords, listed)

    schema = "node long, group long, copies long, dim int, head int, vector binary, filters binary"
    entries = durable(nodes.select("node", F.xxhash64("label").alias("group"), "copies", "embedding").mapInArrow(decode, schema), "entries")
    sizes = entries.groupBy("group", "dim", "head").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = entries.join(durable(sizes, "sizes"), ["group", "dim", "head"]).withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("group", "dim", "head", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("one"), "node", "copies", "vector", "filters")

    def compare(key, table):
        row, links, root = linked(table, kind, codewords, least)
        node = table["node"].to_numpy()
        return pa.table({"node": node[row], "links": links, "root": node[root]})

    found = durable(pairs.groupBy("group", "dim", "head", "a", "b").applyInArrow(compare, "node long, links long, root long"), "links")
    member = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    grouped = member.join(nodes.select(F.col("node").alias("of"), "name"), F.col("node") == F.col("of"))
    names = grouped.join(grouped.groupBy("component").agg(F.min("name").alias("least")), "component").select("of", "least")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = nodes.select("k1", "k2", "node", "name", "copies").join(counts, "node", "left").join(names, F.col("node") == F.col("of"), "left")
    result = durable(result.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "name").alias("component")), "result")
    forget(entries)
    good = rows.where("fine").join(result, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("id", "n_links", "component")
    return good.union(rows.where("not fine").select("id", F.lit(0).cast("long"), F.col("id")))
