"""Bands of least hashes, which say what fingerprints are compared."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semilat.llm import simhash


def test_similar_sets_share_a_band_and_others_none():
    rng = np.random.default_rng(3)
    for n in (9, 90, 900):
        for _ in range(300):
            h = rng.integers(0, 2**64, n + n // 9, np.uint64)
            a, b = h[:n], h[n // 9 :]  # similarity 0.8
            assert np.intersect1d(simhash.bands(a), simhash.bands(b)).size
            assert not np.intersect1d(simhash.bands(a), simhash.bands(~h)).size
    assert len(simhash.bands(np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_links_within_bands_join_what_all_pairs_join(spark, tile_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (3, 4), np.uint64)
    fps, cells = [], []
    for cell, size in ((0, 2), (1, 8), (2, 30)):
        for _ in range(size):
            row = base[cell].copy()
            row[rng.integers(4)] ^= np.uint64(1) << np.uint64(rng.integers(64))
            fps.append(row.astype(">u8").tobytes())
            cells.append(cell)
    fps += [rng.integers(0, 2**64, 4, np.uint64).tobytes() for _ in range(20)]
    cells += [2] * 20
    keyed = spark.createDataFrame(pa.table({"fp": pa.array(fps, pa.binary()), "cell": pa.array(cells, pa.int64())}).to_pandas(), "fp binary, cell long").distinct()
    reps = keyed.select("fp").distinct().withColumn("node", F.monotonically_increasing_id()).cache()
    got = simhash.linked_nodes(reps, simhash.band_links(keyed, 10, 4, tile_rows)).join(reps, "node").groupBy("component").agg(F.collect_set("fp").alias("s")).collect()
    want = {frozenset(f for f, c in zip(fps[:40], cells[:40]) if c == cell) for cell in range(3)}
    assert {frozenset(map(bytes, r.s)) for r in got} == {w for w in want if len(w) > 1}
