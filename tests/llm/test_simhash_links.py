"""Links and their components: few links for a large group, none lost."""

import random

import numpy as np
import pyarrow as pa
import pytest

from semilat.llm import common, simhash
from tests.llm.test_simhash_repeats import classes


def test_a_large_group_leaves_few_links(spark):
    rng = np.random.default_rng(8)
    fps = np.zeros((120, 4), np.uint64)
    fps[np.arange(120), rng.integers(4, size=120)] = np.uint64(1) << rng.permutation(64).astype(np.uint64)[np.arange(120) % 60]
    fps = [x.astype(">u8").tobytes() for x in np.unique(fps, axis=0)]
    small = [(f, band * 100 + k // 6) for band in range(12) for k, f in enumerate(rng.permutation(fps).tolist())]
    keyed = lambda rows: spark.createDataFrame([(bytearray(f.ljust(32, b"\0")), c) for f, c in rows], "fp binary, cell long").coalesce(1)
    links = simhash.band_links(keyed((f, 1) for f in fps), 10, 4, 7)
    assert links.count() <= len(fps) + (len(fps) // 7 + 1) ** 2
    links = simhash.band_links(keyed(small), 10, 4, 4096).coalesce(1)
    assert links.count() <= 4 * len(fps)
    reps = spark.createDataFrame(pa.table({"fp": pa.array(fps, pa.binary()), "node": range(len(fps))}).to_pandas(), "fp binary, node long")
    assert simhash.linked_nodes(reps, links).groupBy("component").count().collect() == [(0, len(fps))]


def test_tiles_of_a_cluster_are_linked_by_what_stands_for_their_sets():
    sets = [np.arange(20, dtype=np.uint64) for _ in range(6)]
    x, y = simhash.exact_links(sets, 3, simhash.Fraction(4, 5), np.array([0, 0, 0, 1, 1, 1]))
    assert (x.tolist(), y.tolist()) == ([1], [0])


@pytest.mark.parametrize("kind", ["path", "zigzag", "star", "random", "none"])
def test_components_reach_the_smallest_node(spark, kind):
    rng = random.Random(7)
    links = {
        "path": [(i, i + 1) for i in range(60)], "zigzag": [(i // 2 if i % 2 else 60 - i // 2, (i + 1) // 2 if (i + 1) % 2 == 0 else 60 - (i + 1) // 2) for i in range(40)],
        "star": [(50, i) for i in range(60)] + [(50, 50), (50, 3)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)], "none": [],
    }[kind]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(91, links)
    assert got == {x: want[x] for link in links for x in link if link[0] != link[1]}
