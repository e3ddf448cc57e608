"""Merging is commutative, associative and idempotent; sequential rules equal their definitions."""

import random
import struct
import zlib

import pytest

from semilat.operators import clocks, counters, gc, merkle, registers, sequences, sets, trees
from semilat.functions import scalars
from semilat.functions.tags import tag
from semilat.sources import frames, log
from semilat.streaming import live

from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def states(spark):
    rng = random.Random(5)
    return [spark.createDataFrame([(f"o{rng.randrange(3)}", f"r{rng.randrange(4)}", rng.randrange(1000)) for _ in range(60)], "obj string, replica string, component long") for _ in range(3)]


def test_counter_laws(states):
    a, b, c = states
    join = lambda x, y: counters.merged(x.unionByName(y))
    assert rows(join(a, b)) == rows(join(b, a))
    assert rows(join(join(a, b), c)) == rows(join(a, join(b, c)))
    assert rows(join(a, a)) == rows(counters.merged(a))
    assert counters.changed(counters.merged(a), counters.merged(a)).where("changed").count() == 0


def test_latest_laws(spark):
    rng = random.Random(6)
    entries = spark.createDataFrame([(rng.randrange(5), rng.randrange(9), 0, f"r{k % 3}", k) for k in range(80)], "key long, wall long, logical long, replica string, v long")
    keyed = registers.latest(entries.dropDuplicates(["wall", "replica"]), ["key"], ["v"], tag("wall", "logical", "replica"))
    shuffled = registers.latest(entries.dropDuplicates(["wall", "replica"]).orderBy(F.rand(3)), ["key"], ["v"], tag("wall", "logical", "replica"))
    assert rows(keyed) == rows(shuffled)
    best = max(((r.tag.wall, r.tag.logical, r.tag.replica), r.key) for r in keyed.collect())
    assert best[0][0] == max(r.wall for r in entries.collect())
    assert registers.tag_conflicts(entries, ["wall", "logical", "replica"], ["key", "v"]).count() > 0


def test_observed_remove_keeps_concurrent_adds(spark):
    log_ = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 1), (3, "a", "error", 1)], "op long, replica string, obj string, elem long")
    tombs = sets.tombstones(log_, F.col("obj") == "error")
    assert [r.op for r in tombs.collect()] == [1]
    assert [r.op for r in sets.live(log_.where("obj <> 'error'"), tombs).collect()] == [2]


def test_multi_value_register(spark):
    writes = spark.createDataFrame([("o", "a", 1, 10), ("o", "a", 2, 600), ("o", "b", 1, 20), ("o", "c", 1, 700)], "obj string, replica string, ctr long, op long")
    assert rows(registers.multi_value(writes, registers.contexts_at_rounds(writes, 500)).select("replica", "ctr")) == [("a", 2), ("c", 1)]


def test_clock_fold():
    assert clocks.fold([(5, None, None), (5, None, None), (3, None, None), (6, 9, 4), (9, 9, 2), (20, 1, 1), (2, 20, 7)]) == [(5, 0), (5, 1), (5, 2), (9, 5), (9, 6), (20, 0), (20, 8)]
    assert clocks.fold([(0, None, None)]) == [(0, 1)]


def test_sequence_order():
    assert sequences.preorder([None, 1, 1, 2, None, 99], [1, 2, 3, 4, 5, 6]) == [5, 1, 3, 2, 4]


def test_deep_chain(spark):
    n = 20_000
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("doc"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    placed = sequences.ordered(nodes, "doc")
    assert placed.where("ord <> id + 1").count() == 0 and placed.count() == n


def test_moves_cut_cycles(spark):
    nodes = spark.createDataFrame([("l", i) for i in (1, 2, 3, 4)], "doc string, id long")
    moves = spark.createDataFrame([("l", 1, 10, 2, 0), ("l", 2, 11, 1, 0), ("l", 3, 12, 77, 0), ("l", 4, 3, 1, 0)], "doc string, id long, tag long, anchor long, rank long")
    # 3's anchor is unknown: root. 2 attaches to 1 first, so 1 can't go below 2. 4's move is older than 4 itself.
    assert [r.id for r in sequences.moved(nodes, moves, "doc").orderBy("ord").collect()] == [3, 1, 2, 4]


def test_tombstone_hides_subtree(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    tombs = spark.createDataFrame([("b",)], "id string")
    assert rows(trees.visible(nodes, tombs)) == [("a", 0), ("d", 1)]
    assert trees.visible(nodes.limit(0), tombs).count() == 0


def test_history_takes_the_least_distance(spark):
    edges = spark.createDataFrame([(4, 3), (4, 1), (3, 2), (2, 1), (1, None)], "id long, parent long")
    assert rows(trees.ancestry(edges, spark.createDataFrame([(4,)], "id long"))) == [(4, 1, 1), (4, 2, 2), (4, 3, 1), (4, 4, 0)]


def test_collection_is_guarded(spark):
    nodes = spark.createDataFrame([("d", 1, None), ("d", 2, 1), ("d", 3, 2)], "doc string, id long, parent long")
    pick = lambda *ids: spark.createDataFrame([("d", i) for i in ids], "doc string, id long")
    assert [r.id for r in gc.unsafe(nodes, pick(2), "doc").collect()] == [2]
    assert gc.unsafe(nodes, pick(2, 3), "doc").count() == 0
    acks = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (2, "b", 7), (2, "a", 8), (2, "zz", 8)], "epoch long, member string, tag long")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "epoch long, member string")
    assert [r.tag for r in gc.stable(acks, members).collect()] == [7]
    tombs = spark.createDataFrame([(i,) for i in range(10)], "op long")
    all_acked = tombs.select(F.col("op").alias("tag"))
    assert sorted(r.op for r in gc.collectable(tombs, all_acked, keep=3, most=5).collect()) == [0, 1, 2, 3, 4]


def test_merkle_root(spark):
    import hashlib

    sha = lambda b: hashlib.sha256(b).digest()
    for n in (1, 2, 3, 5, 8):
        entries = spark.createDataFrame([(1, f"k{i:03}", f"v{i}") for i in range(n)], "tree long, k string, v string")
        level = [sha(b"\0" + bytes([4]) + f"k{i:03}".encode() + sha(f"v{i}".encode())) for i in range(n)]
        while len(level) > 1:
            level = [sha(b"\1" + level[i] + (level[i + 1] if i + 1 < len(level) else bytes(32))) for i in range(0, len(level), 2)]
        found = merkle.roots(merkle.leaves(entries, F.col("k"), F.col("v"), "tree"), "tree").collect()
        assert [r.root for r in found] == [level[0].hex()]


def test_replay_is_all_or_error(spark):
    arrivals = spark.createDataFrame([("g", "a", i, i, "p") for i in range(1, 9)], "grp string, replica string, ctr long, op long, payload string")
    kept = log.appended(arrivals.unionAll(arrivals), "grp", "op", F.col("payload"))
    assert [r.seq for r in log.replay(kept, "grp", 5, 3).orderBy("seq").collect()] == [6, 7, 8]
    with pytest.raises(Exception, match="larger than allowed"):
        log.replay(kept, "grp", 5, 2).collect()


def test_frames():
    assert frames.crc32c(b"123456789") == 0xE3069283
    for payload in (b"", b"x", b"ab" * 500):
        for version in (1, 2):
            frame = frames.encode_one(3, b"utf8", payload, version)
            assert frames.decode_one(frame) == (version, 3, "utf8", payload)
            for bad in (frame[:-1], frame + b"\0", b"X" + frame[1:], frame[:6] + bytes([frame[6] ^ 1]) + frame[7:]):
                with pytest.raises((ValueError, zlib.error)):
                    frames.decode_one(bad)
    assert len(frames.encode_one(1, b"", b"ab" * 500, 2)) < 100
    with pytest.raises(ValueError):
        frames.take(b"\x80\x00", 0)
    assert struct.unpack(">I", frames.encode_one(1, b"", b"", 1)[-4:])[0] == frames.crc32c(b"\x01\x01\x00\x00")


def test_frame_columns(spark):
    df = spark.createDataFrame([(b"bad",), (frames.encode_one(5, b"c", b"p", 1),), (None,)], "f binary").select(frames.decode_frame("f").alias("d")).select("d.*")
    got = df.collect()
    assert got[0].error and got[0].payload is None and (got[1].type_id, bytes(got[1].payload)) == (5, b"p") and got[2].error
    batch = spark.createDataFrame([([b"a", b"", b"xyz"],)], "f array<binary>").select(frames.split_batch(frames.join_batch("f")).alias("f")).first().f
    assert [bytes(x) for x in batch] == [b"a", b"", b"xyz"]


def test_scalars(spark):
    got = spark.createDataFrame([("a b",), (" a",), ("",), ("a\x01",), (None,)], "n string").select(scalars.name_valid(F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]
    got = spark.createDataFrame([("1",), ("-0.5e3",), ('"x"',), ("{}",), ("[1]",), ("01",), ("null",), (None,)], "j string").select(scalars.json_scalar(F.col("j")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, True, False, False, False, True, False]


def test_inbox_rule():
    assert live.advance(0, [], [2, 3, 5]) == (0, [(2, 3), (5, 5)])
    assert live.advance(0, [(2, 3), (5, 5)], [1, 1, 2]) == (3, [(5, 5)])
    assert live.advance(3, [(5, 5)], [4, 2]) == (5, [])
    assert live.advance(3, [], [1, 2]) == (3, [])


def test_presence_stream(spark):
    beats = spark.createDataFrame([("a", 1, "x", 10), ("a", 3, None, 12), ("a", 2, "y", 99), ("b", 1, "z", 5)], "actor string, clock long, state string, seen long")
    assert rows(live.presence(spark, beats)) == [("a", 3, None, 12), ("b", 1, "z", 5)]


def test_witnessed_equals_the_fold(spark):
    rng = random.Random(7)
    events = [(f"r{r}", i + 1, rng.randrange(6) * (r > 0), *((rng.randrange(8), rng.randrange(4)) if rng.random() < 0.4 and r > 0 else (None, None))) for r in range(3) for i in range(120)]
    df = spark.createDataFrame(events, "replica string, ctr long, h long, wall long, logical long")
    got = {(r.replica, r.ctr): (r.wall, r.logical) for r in clocks.witnessed(df, "replica", "ctr", "h", "wall", "logical").collect()}
    for r in range(3):
        mine = [e for e in events if e[0] == f"r{r}"]
        assert [got[e[0], e[1]] for e in mine] == clocks.fold([e[2:] for e in mine])


def test_running_totals_over_blocks(spark):
    from semilat.functions.windows import numbered, prefix

    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), i * 7, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, at long, v long")
    got = {r["at"]: r for r in numbered(prefix(df, ["k"], "at", {"s": F.col("v")}, {"m": F.col("v")}, width=100), ["k"], "at", "n").collect()}
    for key in ("a", "b", None):
        mine = [x for x in data if x[0] == key]
        for n, (_, at, _) in enumerate(mine):
            seen = [v for _, _, v in mine[: n + 1]]
            assert (got[at].s, got[at].m, got[at].n) == (sum(seen), max(seen), n + 1)
    assert numbered(df.limit(0), ["k"], "at", "n").count() == 0


def test_moves_against_plain_code(spark, sf_dir):
    from semilat.plans import catalogue

    rows = catalogue.ops(spark, sf_dir).collect()
    want = []
    for obj in {r.obj for r in rows}:
        mine = [r for r in rows if r.obj == obj]
        ids, latest = {r.elem for r in mine}, {}
        for r in mine:
            if r.op > latest.get(r.elem, (-1,))[0]:
                latest[r.elem] = (r.op, r.elem * 7 % 120, r.ctr % 10)
        info = {i: latest[i] if latest[i][0] > i else (i, None, 0) for i in ids}
        parent = {}
        for i in sorted(ids, key=lambda i: (-info[i][0], info[i][2], i)):
            anchor = info[i][1] if info[i][1] in ids else None
            above, at = set(), anchor
            while at is not None and at not in above:
                above.add(at)
                at = parent.get(at)
            parent[i] = None if i in above else anchor
        out = []

        def walk(node):
            for child in sorted((i for i in ids if parent[i] == node), key=lambda i: (-info[i][0], info[i][2], -i)):
                out.append(child)
                walk(child)

        walk(None)
        want += [(obj, i, n) for n, i in enumerate(out, 1)]
    assert sorted(map(tuple, catalogue.QUERIES["movelist_order"](spark, sf_dir).collect())) == sorted(want)


def test_undo_and_redo():
    from semilat.operators import editing

    assert editing.undo(["do", "do", "undo", "undo", "redo"]) == [True, False, False, False, False]
    assert editing.undo(["undo", "do", "undo", "do", "redo"]) == [False, False, False, True, False]


def test_fetch_is_all_or_error(spark):
    from semilat.operators import protocol

    log_ = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    ask = lambda *ks: protocol.fetched(log_, spark.createDataFrame([(k,) for k in ks], "k long"), ["k"]).collect()
    assert [tuple(r) for r in ask(2)] == [(2, "b")]
    with pytest.raises(Exception, match="missing"):
        ask(2, 3)


def test_checksums_of_long_data():
    table = frames.crc_table()
    for size in (0, 1, 4095, 4096, 5000, 70001):
        data, crc = random.Random(size).randbytes(size), 0xFFFFFFFF
        for b in data:
            crc = table[(crc ^ b) & 255] ^ crc >> 8
        assert frames.crc32c(data) == crc ^ 0xFFFFFFFF
