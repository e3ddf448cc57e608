"""The language model over whole documents against a plain computation."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from semilat.llm import common, ppm, queries


def frame(text):
    return (text or "").encode().lower() + ppm.END


def plain_cost(contexts, s, order):
    total = 0.0
    for i in range(len(s)):
        excluded, found = set(), False
        for k in range(min(order, i), -1, -1):
            seen = contexts.get(s[i - k : i])
            if seen is None:
                continue
            live = {a: n for a, n in seen.items() if a not in excluded}
            size = sum(live.values()) + len(live)
            if s[i] in live:
                total += math.log10(live[s[i]] / size)
                found = True
                break
            if live:
                total += math.log10(len(live) / size)
            excluded |= set(seen)
        if not found:
            total -= math.log10(ppm.SYMBOLS - len(contexts.get(b"", ())))
    return total


def plain_scores(rows, order=6):
    contexts = defaultdict(Counter)
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = frame(text)
            for at in range(len(s)):
                for k in range(min(order, at) + 1):
                    contexts[s[at - k : at]][s[at]] += 1
    return {i: plain_cost(dict(contexts), frame(text), order) for i, text in rows}


@pytest.mark.parametrize("hot_pairs,hot,chunk", [(ppm.HOT_PAIRS, ppm.HOT, ppm.CHUNK), (50, 20, 1000)])
def test_scores_whole_documents(spark, sf_dir, hot_pairs, hot, chunk, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    few = common.read(spark, sf_dir, "documents").orderBy("doc_id").limit(40)
    rows = [(r.doc_id, r.text) for r in few.collect()] + [(900, " \t A  a\x00\n"), (901, None), (901, None), (902, ""), (903, "é中🙂 \x1c\x85 x")]
    want, words = plain_scores(rows), {i: (t or "").encode().lower().split() + [ppm.END] for i, t in rows}
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in (t or "").encode().lower().split() + [ppm.END])
    n, v = sum(train.values()), len(train)
    got = ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, hot_pairs=hot_pairs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(w), sum(x in train for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)


def test_white_space_is_coded(spark):
    rows = [(i, "one two three") for i in range(40)] + [(100, "one  two\tthree")]
    got = {r.doc_id: r.score for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] > got[100] + 2


def test_the_costs_are_a_distribution():
    data = b"abracadabra, abracadabra"
    _, key = ppm.coded([(0, data + ppm.END, 0)], 3)
    trie = ppm.Trie(*ppm.total(key, np.ones(len(key), np.int64)), 3)
    for context in (b"", b"a", b"abr", b"xbr", b"zz"):
        k = min(3, len(context))
        keys = np.array([sum(c << 8 * (j + 1) for j, c in enumerate(reversed(context[-k:] if k else b""))) | s for s in range(256)], np.uint64)
        assert math.isclose((10 ** trie.cost(np.full(256, k), keys)).sum(), 1, rel_tol=1e-9)


def test_frequent_costs_are_found():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**60, 5000, dtype=np.uint64))
    costs = ppm.Costs(keys[::2], np.arange(len(keys))[::2].astype(float))
    hit, cost = costs.find(keys)
    assert hit[::2].all() and not hit[1::2].any() and (cost[::2] == np.arange(len(keys))[::2]).all() and not cost[1::2].any()
    hit, cost = ppm.Costs(keys[:0], np.zeros(0)).find(keys)
    assert not hit.any() and not cost.any()


def test_the_query_sees_the_order_of_words(spark, tmp_path):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:20]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "of the sea and of the land") for i in ids] + [(held[0], "of the sea and of the land"), (held[1], "land the the of of sea and"), (500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op4_ppm(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 3
    want = plain_scores(rows)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_the_order_stays_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(ppm, "PART", 100)
    rows = [(i, " ".join(f"{(i * 7919 + j * 104729) % 99991:05d}" for j in range(30))) for i in range(40)]
    want = plain_scores(rows)
    got = ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scores(empty).count() == 0


def test_words_of_a_slice_of_a_large_column():
    column = pa.array(["X" * 3_000_000, "Y " * 500_000, None, "x" * 3_000_000 + " Z"])
    for at, want in enumerate((["x" * 3_000_000], ["y"] * 500_000, [], ["x" * 3_000_000, "z"])):
        words, row = ppm.words_of(column.slice(at, 1))
        assert words.to_pylist() == [w.encode() for w in want] and not row.any()


def test_pairs_leave_a_task_in_small_parts(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(ppm, "LEAVE", 100, raising=False)
    rows = spark.createDataFrame([(" ".join(str(i * 7919 % 99991) for i in range(400)), False)], "text string, held_out boolean")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: sizes.extend(b.num_rows for b in run(iter(self.toArrow().to_batches()))) or spark.createDataFrame([], schema))
    ppm.pair_counts(rows, 6)
    assert sum(sizes) > 1000 and max(sizes) <= 100


def test_totals_take_less_room():
    keys, counts = np.arange(1 << 20, dtype=np.uint64) // np.uint64(2), np.ones(1 << 20, np.int64)
    tracemalloc.start()
    got = ppm.total(keys, counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == np.arange(1 << 19, dtype=np.uint64)).all() and (got[1] == 2).all()
    assert most <= 36 * len(keys)
    assert [len(x) for x in ppm.total(keys[:0], counts[:0])] == [0, 0]


def test_frequent_pairs_leave_a_task_once(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 1000)
    monkeypatch.setattr(ppm, "KEPT", 4000)
    left = []
    rows = spark.createDataFrame([("of the sea and of the land " * 30 + " ".join(str((i * 7919 + j * 104729) % 99991) for j in range(40)), i % 5 == 1) for i in range(60)], "text string, held_out boolean")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: left.extend(run(iter(self.toArrow().to_batches()))) or spark.createDataFrame([], schema))
    ppm.pair_counts(rows, 6)
    got, times, want = Counter(), Counter(), Counter()
    for batch in left:
        got.update(dict(zip(batch["key"].to_pylist(), batch["n"].to_pylist())))
        times.update(batch["key"].to_pylist())
    for text, held in rows.collect():
        want.update((ppm.coded([(0, frame(text), 0)], 6)[1] | np.uint64(held << ppm.HELD)).view(np.int64).tolist())
    assert got == want and len(want) > 3 * ppm.KEPT
    assert max(times[key] for key, n in want.items() if n > 1000) == 1


def test_words_of_several_chunks_are_looked_up_at_once(monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 1000)
    calls, look_up = [], ppm.pc.index_in
    monkeypatch.setattr(ppm.pc, "index_in", lambda *x, **y: calls.append(1) or look_up(*x, **y))
    texts = [f"A word {i} " * (i % 50) for i in range(200)] + [None, "x" * 3000, ""]
    batch, listed = pa.record_batch({"text": pa.array(texts)}), pa.array([b"a", b"7", ppm.END], pa.binary())
    seen = list(ppm.listed_words(batch, listed))
    assert len(seen) > 30 and len(calls) <= len(seen) / 5
    done = 0
    for part, word, row, at in seen:
        own = [[w.encode() for w in (t or "").lower().split()] + [ppm.END] for t in texts[done : done + len(part)]]
        assert part["text"].to_pylist() == texts[done : done + len(part)]
        assert word.to_pylist() == [w for o in own for w in o] and row.tolist() == [i for i, o in enumerate(own) for _ in o]
        assert at.to_pylist() == [{b"a": 0, b"7": 1, ppm.END: 2}.get(w) for o in own for w in o]
        done += len(part)
    assert done == len(texts)
