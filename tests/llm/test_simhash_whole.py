"""Near copies that bands of least hashes miss, and the bounds by which they are found."""

import itertools
from fractions import Fraction

import numpy as np
import pytest

from semilat.llm import simhash

#: Shingles of words 0-12 and 1-13 have a similarity of 0.8 and share no band.
APART = [
    (618410, 893448, 235483, 507313, 278548, 219750, 573186, 513002, 610763, 897631, 99860, 4278, 173849, 184122),
    (199350, 369014, 928152, 460871, 657160, 369470, 341441, 636242, 690618, 262852, 977398, 630234, 184461, 451410),
]


def similarity(a, b):
    return Fraction(len(np.intersect1d(a, b)), len(np.union1d(a, b)))


def test_near_copies_that_share_no_band_are_removed(spark):
    rows = []
    for i, numbers in enumerate(APART):
        w = [f"w{k}" for k in numbers]
        a, b = " ".join(w[:-1]), " ".join(w[1:])
        x, y = (simhash.shingle_hashes(t.encode(), 5) for t in (a, b))
        assert similarity(x, y) == Fraction(4, 5) and not np.intersect1d(simhash.bands(x), simhash.bands(y)).size
        rows += [(2 * i, a), (2 * i + 1, b)]
    rows += [(10, "one of its own"), (11, None), (12, " ")]
    kept = simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 10, 11]


@pytest.mark.parametrize("tile_rows", [4096, 5])
def test_unjoined_finds_each_pair_at_the_least_similarity(spark, tile_rows):
    rng = np.random.default_rng(8)
    least, counts = Fraction(4, 5), rng.integers(0, 4, simhash.BUCKETS).astype(np.int32)
    common, sets = rng.integers(0, 2**64, 30, np.uint64), []
    for _ in range(40):
        base = np.append(rng.integers(0, 2**64, rng.integers(1, 60), np.uint64), rng.choice(common, rng.integers(0, 30), False))
        for _ in range(4):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**64, rng.integers(0, 3), np.uint64))))
    sets = [h for h in sets if len(h)]
    groups = [i if i % 7 else 0 for i in range(len(sets))]
    rows = [(i, g, len(h), simhash.prefix(h, counts, least).tolist(), simhash.parities(h)) for i, (g, h) in enumerate(zip(groups, sets))]
    made = spark.createDataFrame(rows, "node long, grp long, n long, prefix array<long>, parity binary")
    found = simhash.unjoined(made, least, tile_rows).collect()
    top = simhash.roots(len(sets), np.array([r.a for r in found]), np.array([r.b for r in found]))
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if groups[i] != groups[j] and similarity(sets[i], sets[j]) >= least]
    assert len(near) > 40 and any(similarity(sets[i], sets[j]) == least for i, j in near)
    assert all(top[i] == top[j] for i, j in near)
    assert len(np.unique(top)) > 20
