"""Queries against their SQL on rows and sizes that the given tables lack."""

import datetime
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from semilat.operators import gc, presence, sequences, trees
from semilat.plans import catalogue
from semilat.sources import frames
from semilat.streaming import live

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def agrees(spark, tmp_path):
    """Writes tables (name: DataFrame) and compares a query on them with its SQL."""

    def plain(v):
        return v if isinstance(v, (str, bytes, type(None))) else repr(v)

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalogue.QUERIES[name](spark, os.fspath(tmp_path))
        found = con.execute(catalogue.ORACLES[name])
        at = [[x[0] for x in found.description].index(c) for c in df.columns]
        want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
        got = Counter(tuple(map(plain, r)) for r in df.collect())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
        return got

    return check


def events(spark, rows):
    """rows(event_id, user_id, event_type, value)"""
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + datetime.timedelta(seconds=n), user, kind, value, '{"k": 1}') for n, (i, user, kind, value) in enumerate(rows)], EVENTS)


def test_an_altered_checksum_is_never_the_frames_own(spark, agrees):
    zero = [n for n in range(3000) if frames.encode_one(3, b"", str(n).encode(), 1).endswith(b"\0")]
    assert zero
    rows = [(35 * k, k % 7, "view", n / 100) for k, n in enumerate(zero + [5, 6, 7])] + [(7 * k, 3, "view", None if k % 2 else 1.0) for k in range(1, 30) if k % 5]
    assert agrees("frame_errors", events=events(spark, rows))


def test_acknowledged_numbers_from_a_million_on_are_unknown(spark, agrees):
    ids = [1, 2, 10, 11, 20, 72, 999_990, 999_999, 1_000_000, 1_000_001, 1_000_003, 1_000_010, 1_000_020, 2_000_001, 2_000_003]
    got = agrees("gc_rejected_acks", events=events(spark, [(i, i % 7, "view", 1.0) for i in ids]))
    assert any("1000003" in row for row in got)


def test_walks_hold_more_rows_than_a_recursive_query_may(spark, monkeypatch):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        chain = [(i, i - 1 if i % 40 else None) for i in range(200)]
        nodes = spark.createDataFrame(chain, "id long, parent long")
        assert Counter(r.depth for r in trees.visible(nodes, nodes.where("id = 57")).collect()) == {d: 5 if d < 17 else 4 for d in range(40)}
        assert {tuple(r) for r in trees.paths(nodes.where("id < 2"), "id", 3).collect()} == {(0, "999"), (1, "999/998")}
        heads = spark.createDataFrame([(39,), (20,), (199,)], "id long")
        want = {(h, i, h - i) for h in (39, 20, 199) for i in range(h // 40 * 40, h + 1)}
        assert {tuple(r) for r in trees.ancestry(nodes, heads).collect()} == want
        assert {r.problem for r in trees.unreachable(nodes.where("id <> 40")).collect()} == {"waits"}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    round_ = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestry(round_, spark.createDataFrame([(1,)], "id long"), levels=8)


def test_the_least_distance_over_merges(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (9, 5), (5, 1), (1, None), (9, 1)], "id long, parent long")
    got = trees.ancestry(edges, spark.createDataFrame([(9,)], "id long")).collect()
    assert {tuple(r) for r in got} == {(9, 9, 0), (9, 8, 1), (9, 7, 2), (9, 5, 1), (9, 1, 1)} and len(got) == 5


def test_acknowledged_tags_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(gc, "PART", 10)
    acks = spark.createDataFrame([(1, m, t) for t in range(100) for m in "abc" if t % 2 or m != "a"] + [(0, "a", 2), (1, "b", 3)], "epoch long, member string, tag long")
    members = spark.createDataFrame([(1, m) for m in "abc"] + [(0, "z")], "epoch long, member string")
    got = gc.stable(acks, members)
    assert sorted(r.tag for r in got.collect()) == list(range(1, 100, 2))
    assert got.rdd.getNumPartitions() == acks.count() // 10 + 1


def test_runs_that_wait_are_arrays():
    rng = np.random.default_rng(1)
    counters = rng.permutation(np.array([c for c in range(1, 5000) if c % 17 != 3]))
    frontier, first, last = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = set()
    for part in np.array_split(counters, 6):
        frontier, first, last = live.merged(frontier, first, last, np.append(part, part[:3]))
        seen |= set(part.tolist())
        top = next(c for c in range(1, 5001) if c not in seen) - 1
        assert frontier == top and [c for a, b in zip(first, last) for c in range(a, b + 1)] == sorted(c for c in seen if c > top)


def test_documents_are_ordered_without_a_group_each(spark):
    rows = [(d, i, i - 1 if i else None) for d in [*range(300), None] for i in range(3)] + [(7, 9, 0), (8, 5, 77), (1, 1, 0)]
    big = [(1000, i, i - 1 if i else None) for i in range(25_000)]
    placed = sequences.ordered(spark.createDataFrame(rows + big, "doc long, id long, parent long"), "doc")
    assert "GroupsInPandas" not in placed._jdf.queryExecution().toString()
    got = {}
    for r in placed.collect():
        got.setdefault(r.doc, []).append((r.ord, r.id))
    assert all([i for _, i in sorted(v)] == {7: [0, 9, 1, 2], 1000: list(range(25_000))}.get(d, [0, 1, 2]) for d, v in got.items())
    assert len(got) == 302 and [o for o, _ in sorted(got[1000])] == list(range(1, 25_001))


@pytest.mark.parametrize("near", [40, 3])
def test_peers_beside_the_bound_are_ranked_as_well(spark, agrees, monkeypatch, near):
    monkeypatch.setattr(presence, "NEAR", near)
    rows = [(i, i % 3) for i in range(200)] + [(900, 7), (901, 8), (902, 8), (5, 2), (903, None)]
    agrees("gossip_peers", customer=spark.createDataFrame(rows, "c_custkey long, c_nationkey int"))
