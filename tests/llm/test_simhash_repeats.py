"""Near copies by sets of shingles."""

import random
from fractions import Fraction

import numpy as np
import pytest

from semilat.llm import common, simhash


def test_a_repeated_line_does_not_make_near_copies(spark):
    line = "all rights reserved by the owner of this page and its many other parts"
    rows = [(i, " ".join([line] * 100 + [f"w{i}x{k}" for k in range(60)])) for i in range(6)]
    kept = simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(6))


def plain_links(texts, least=(4, 5), words=5):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return [(a, b) for b in range(len(texts)) for a in range(b) if least[1] * len(sets[a] & sets[b]) >= least[0] * len(sets[a] | sets[b])]


def classes(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = sorted((label[a], label[b]))
        label = [x if c == y else c for c in label]
    return label


def test_exact_links_equal_all_pairs(monkeypatch):
    rng = random.Random(3)
    for few in (1, 3, 24):
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "WIDTH", 7)
        for left in (0, 5):
            base = [str(rng.randrange(99)) for _ in range(60)]
            texts = ["", " \t"] + [" ".join(base[: rng.randrange(40, 60)] + [str(rng.randrange(9999)) for _ in range(rng.randrange(6))]) for _ in range(20)] + ["other words"]
            sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
            x, y = simhash.exact_links(sets, left, Fraction(4, 5))
            want = [(a, b) for a, b in plain_links(texts) if not left or a < left <= b]
            assert classes(len(texts), zip(x.tolist(), y.tolist())) == classes(len(texts), want)


@pytest.mark.parametrize("shingles,sets", [(simhash.TILE_SHINGLES, simhash.TILE_SETS), (200, 3)])
def test_large_clusters_are_confirmed_in_tiles(spark, monkeypatch, shingles, sets):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", shingles)
    monkeypatch.setattr(simhash, "TILE_SETS", sets)
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base[:k] + [f"x{rng.randrange(10**6)}"] + base[k + rng.randrange(9) :]) for k in (rng.randrange(60) for _ in range(12))]
    kept = simhash.near_copies_removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile_rows=16)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(len(texts), plain_links(texts))))


def test_one_id_on_two_texts_and_null_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "un deux trois quatre cinq six sept huit")
    rows = [(7, a, "s"), (7, b, "s"), (7, a, "t"), (None, a, "s"), (None, c, "s"), (None, c, "s"), (9, b, "s"), (3, None, "s"), (4, " ", "s")]
    kept = simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(7, a), (7, b), (None, c), (3, None)], key=repr)


def test_a_null_id_links_others(spark):
    nodes = [0b00000, 0b00011, 0b01111]  # bits apart: 2, 2 and 4
    df = spark.createDataFrame([(k, bytearray(x.to_bytes(8, "big"))) for k, x in zip((1, None, 3), nodes)], "id long, fp binary")
    assert simhash.groups_of(df, 3, 1, 4096).orderBy("id").select("id", "component").collect() == [(None, 1), (1, 1), (3, 1)]


def test_roots_lose_no_link():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 40)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(60))]
        x, y = np.array(links, np.int64).reshape(-1, 2).T
        assert common.roots(n, x, y).tolist() == classes(n, links)
