"""Each training-data operator against a plain computation on whole small tables, and its edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semilat.llm import cap_filters, common, html_extract, langid, mixing, packing, pii, ppm, queries, simhash, warc, winnow

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27),
    (None, "one two three four five six", None, "s", 27), (5, "word " * 30000, "en", "s", 150000), (6, "x" * 200000, None, None, None), (7, " \t\n ", "xx", "é", 4), (8, "é中🙂 ok\x00\x1c", "fr", "s", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({"id": F.lit(9), "fp": F.lit("clash"), "word": F.lit(1), "size": F.lit("s"), "node": F.lit(0), "uid": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.read(spark, sf_dir, "documents")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def classes(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(999, 999)]
    want = classes({x for p in links for x in p}, links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: want[k] for k in got} and {k for a, b in links if a != b for k in (a, b)} == set(got)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. HTML


def test_html_held_out_pages():
    chain, rng, exact = html_extract.trained(), random.Random(4321), 0
    for _ in range(200):
        page, content = html_extract.generated(rng)
        exact += html_extract.main_text(page, chain) == "\n".join(" ".join(c.split()) for c in content)
    assert exact >= 180


def test_html_whole_table(spark, sf_dir):
    import html

    got = {r.page_id: r for r in queries.op1_html(spark, sf_dir).collect()}
    for r in common.read(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_viterbi_is_best():
    chain, rng = html_extract.trained(), random.Random(7)
    for _ in range(30):
        found = html_extract.blocks(html_extract.generated(rng)[0])[:9]
        rows, same = html_extract.page_features(found)
        emit = [sum(chain.score.get(f, 0.0) for f in r) for r in rows]

        def value(y):
            return sum(e for e, k in zip(emit, y) if k) + sum(chain.pair[same[i]][y[i - 1]][y[i]] for i in range(1, len(y)))

        best = max(value([m >> i & 1 for i in range(len(found))]) for m in range(2 ** len(found)))
        assert math.isclose(value([int(k) for k in chain.label(found)]), best, rel_tol=1e-9)


def test_html_edges(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "no markup"), (5, "u", "<article><p>A &amp; b&nbsp;&lt;c&gt;<p>D\n e<br>f"), (5, "u", "<article><p>A &amp; b&nbsp;&lt;c&gt;<p>D\n e<br>f"), (6, "u", "<article>" + "<p>some words here.</p>" * 20000 + "</article>"), (7, "u", "</p></div><script>x<p>"), (None, "u", "<!-- x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text_", F.lit(1))
    got = html_extract.extracted(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[7] == by[None] == "" and by[5] == "A & b <c>\nD e f" and by[6].count("\n") == 19999
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_html_markup():
    chain = html_extract.trained()
    text = lambda page: [b[0] for b in html_extract.blocks(page)]
    assert html_extract.main_text("<article><p title=don't>First paragraph of it, long enough.</p><p>Second one isn't short, either.</p></article>", chain) == "First paragraph of it, long enough.\nSecond one isn't short, either."
    assert text("<script src=/a/>var x = 1;</script><p>a</p><svg/><p>b</p><script>x = \"<div class='\" + (a<b) </script><p class='z'>c</p>") == ["a", "b", "c"]
    assert text("<p data-x='" + "y" * 6000 + "'>rest</p>") == ["rest"]
    assert text("a < b <") == ["a < b <"] and text("<p>x<!-- y -->z<!doctype q></p>w") == ["xz", "w"] and text('<p title="abc>text</p>') == ["text"]
    assert text("<svg>a<p>b") == ["a", "b"] and text("<style>a<p>b") == []


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<svg>", "</script ", "<p title='", "<!-- ", "<li><form>", "</p>", "<div a=", "<"])
def test_html_takes_linear_time(unit):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_extract.blocks(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


# 2. WARC


def test_warc_round_trip_and_edges(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(100, "u\r\nx", None), (101, None, ""), (None, None, ""), (None, "n", "alone"), (None, "n", "alone"), (7, "a", "x"), (7, "a", "x"), (6, "a", "x"), (102, "big", "y" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit(1), "payload": F.lit("clash")})
    got = warc.round_trip(df, archive_bytes=2000, payloads=True).collect()
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = Counter()
    for i, _, h in pages:
        h = h or ""
        first = i == last.get(h)
        want[(i, h.encode() if first else b"", len(h), warc.base32_sha1(h.encode()), "response" if first else "revisit", None if first else last[h])] += 1
    assert Counter((r.id, bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    all_stored = warc.round_trip(df, least=10**9).groupBy("record_type").count().collect()
    assert [(r.record_type, r["count"]) for r in all_stored] == [("response", len(pages))]


def test_warc_reader_rejects():
    import zstandard

    sample = [warc.record(i, "u", b"some payload %d" % i, 13 + len(str(i)), warc.base32_sha1(b"some payload %d" % i), None, i) for i in range(50)]
    words = zstandard.train_dictionary(1024, sample * 20).as_bytes()
    for dictionary in (b"", words):
        tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        archive = warc.start(dictionary) + b"".join(map(tool.compress, sample))
        assert [warc.checked(c)[0] for c in warc.frames(archive)[1]] == list(range(50))
        for bad in (archive[:-3], archive + b"junk", archive[:4] + struct.pack("<I", 10**6) + archive[8:]):
            with pytest.raises(warc.Invalid):
                [warc.checked(c) for c in warc.frames(bad)[1]]
    packed_words = zstandard.ZstdCompressor().compress(words)
    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    assert len(list(warc.frames(warc.start(packed_words) + b"".join(map(tool.compress, sample)))[1])) == 50
    for bad in (sample[0][:-1], sample[0].replace(b"payload 0", b"payload 9"), sample[0].replace(b"WARC-Date", b"WARC-Dots"), sample[0].replace(b"WARC/1.1", b"WALK/1.1"), sample[0] + sample[1]):
        with pytest.raises(warc.Invalid):
            warc.checked(bad)


def test_warc_of_other_writers():
    import zstandard

    def rec(kind, block, *more, uid="<urn:uuid:8c1c>"):
        lines = ["WARC/1.0", f"WARC-TYPE: {kind}", f"Warc-Record-Id: {uid}", "warc-date: 2020-01-01T00:00:00Z", *more, f"CONTENT-LENGTH: {len(block)}"]
        return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    page = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    sample = [rec("warcinfo", b"software: x", "Content-Type: application/warc-fields"), rec("request", b"GET / HTTP/1.1\r\n\r\n"), rec("response", page, http), rec("resource", b"raw", "WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"raw").lower()), rec("revisit", b"", "WARC-Refers-To: <urn:uuid:77>"), rec("revisit", b""), rec("metadata", b"a: b", "X-Folded: one", "  two")]
    archive = struct.pack("<II", 0x184D2A50, 3) + b"abc" + b"".join(map(zstandard.ZstdCompressor(write_checksum=True).compress, sample))
    got = [warc.checked(c) for c in warc.frames(archive)[1]]
    assert [(r[0], r[2], r[3], r[5], r[8]) for r in got] == [(None, b"software: x", 11, "warcinfo", None), (None, b"GET / HTTP/1.1\r\n\r\n", 18, "request", None), (None, b"body", 4, "response", None), (None, b"raw", 3, "resource", None), (None, b"", None, "revisit", "<urn:uuid:77>"), (None, b"", None, "revisit", None), (None, b"a: b", 4, "metadata", None)]
    for bad in (rec("response", b"nothing", http), rec("response", page[:-4] + b"x", http, "WARC-Payload-Digest: sha1:AA"), rec("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody", http), rec("revisit", page, http)):
        with pytest.raises(warc.Invalid):
            warc.checked(bad)


def test_warc_reader_takes_linear_time():
    import time

    import zstandard

    one, took = zstandard.ZstdCompressor().compress(b"x" * 300 + bytes(range(256))), []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert sum(1 for _ in warc.frames(one * n)[1]) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3


# 3. Embeddings


def cosine_links(rows, least=0.93):
    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= least]


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            v = base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2, 0.3])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1.0, 3.0])], int(c % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [nan] * 16, 1), (1004, [inf] + [1.0] * 15, 1), (1005, [None] + [1.0] * 15, 1), (1006, rows[0][1], None), (None, rows[0][1], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [1.0], 0), (1010, [5.0], 0)]
    by_place = [(n, v, label) for n, (_, v, label) in enumerate(rows)]
    want, links = Counter(), cosine_links(by_place)
    for a, b in links:
        want[a] += 1
        want[b] += 1
    component = classes(range(len(rows)), links)
    name = lambda n: min((rows[m][0] for m in component if component[m] == component[n] and rows[m][0] is not None), default=None)
    expected = Counter((r[0], want[n], name(n)) for n, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "node": F.lit(2), "group": F.lit(3)})
    for tile in (2048, 4):  # small tiles: hot groups are cut
        assert Counter(map(tuple, cap_filters.near_vectors(df, tile=tile).collect())) == expected
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_planted_clusters_are_found_whole(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(150):  # 64 components, a third of the clusters under one label
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(2, 10))):
            rows.append((len(rows), [float(x) for x in base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.15, 0.22])], 0 if c % 3 == 0 else c))
    links = cosine_links(rows)
    component = classes([r[0] for r in rows], links)
    want = Counter(x for p in links for x in p)
    got = {r.id: (r.n_links, r.component) for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (want[i], component[i]) for i in component}


def test_caps_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    u = cap_filters.unit(rng.standard_normal((2000, 64)))
    w = rng.standard_normal((2000, 64))
    w = cap_filters.unit(w - (w * u).sum(1, keepdims=True) * u)
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * w
    a, b = (cap_filters.list_decode(x, cap_filters.CODEWORDS, cap_filters.LISTED) for x in (u, v))
    assert sum(not np.intersect1d(x, y).size for x, y in zip(a, b)) <= 4
    few = u[:5]
    first, second = cap_filters.codes(64, 32)
    every = (few[:, :32] @ first.T)[:, :, None] + (few[:, 32:] @ second.T)[:, None, :]
    best = np.sort(np.argsort(-every.reshape(5, -1), axis=1)[:, :20], axis=1)
    assert (cap_filters.list_decode(few, 32, 20) == best).all()


# 4. Language model (its costs: test_ppm.py)


def test_scores_edges(odd, spark):
    got = ppm.scores(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 7)} == {1}
    assert ppm.scores(odd.limit(0)).count() == 0
    alone = spark.createDataFrame([(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in ppm.scores(alone).collect())


# 5. Winnowing


def slow_fingerprint(text, gram=winnow.GRAM, window=winnow.WINDOW):
    import xxhash

    def chain(values):
        h = 42
        for x in values:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        return h - 2**64 if h >= 2**63 else h

    w = [xxhash.xxh64_intdigest(x, 42) for x in text.encode().split()]
    h = [chain(w[i : i + gram]) for i in range(len(w) - gram + 1)] if len(w) >= gram else [chain(w)] if w else []
    out = []
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        p = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != p:
            out.append((min(part), p))
    return out


def check_report(got, rows):
    shown = lambda f: " ".join(f"{h % 2**64:X}@{p}" for h, p in f)

    def like(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return 1.0 if not a | b else len(a & b) / len(a | b)

    rows = sorted(((-(2**63) if i is None else i, t or "", i) for i, t in rows), reverse=True)
    prints, want = [slow_fingerprint(t) for _, t, _ in rows], Counter()
    for n, (_, t, i) in enumerate(rows):
        m, h = (n + 1) % len(rows), len(t) // 2
        edited = t[: len(t) - h] + rows[m][1][:h]
        f = slow_fingerprint(edited)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(prints[n]), shown(f), like(prints[n], f), like(prints[n], prints[m]))] += 1
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("rows_in_range", [500, 3])
def test_fingerprints_against_plain_code(spark, docs, rows_in_range, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", rows_in_range)
    check_report(winnow.edit_report(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_edges(odd, spark):
    check_report(winnow.edit_report(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert winnow.edit_report(odd.limit(0)).count() == 0
    check_report(winnow.edit_report(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).collect(), [(5, "a b c d e f g")])


def test_shared_passages_are_found():
    rng = random.Random(8)
    word = lambda: str(rng.randrange(10**6))
    for _ in range(50):
        passage = [word() for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
        a, b = ([word() for _ in range(rng.randrange(60))] + passage + [word() for _ in range(rng.randrange(60))] for _ in range(2))
        assert {h for h, _ in slow_fingerprint(" ".join(a))} & {h for h, _ in slow_fingerprint(" ".join(b))}


# 6. Mixing


def filled(sizes, weights, total, cap=2):
    """Targets by resharing until none is above its cap."""
    full, open_ = {}, dict(enumerate(sizes))
    while open_:
        left, w = total - sum(full.values()), sum(weights[i] for i in open_)
        over = [i for i, s in open_.items() if left * weights[i] / w > cap * s]
        if not over:
            return full | {i: left * weights[i] / w for i in open_}
        for i in over:
            full[i] = float(cap * open_.pop(i))
    return full


def test_targets(spark):
    rng = random.Random(9)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 5, 50, 500, 5000]) for _ in range(rng.randint(1, 12))]
        names = sorted(f"s{i}" for i in range(len(sizes)))
        df = spark.createDataFrame([(n if k < len(sizes) - 1 else None, s) for k, (n, s) in enumerate(zip(names, sizes))], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
        for i, n in enumerate([*names[:-1], None]):
            assert math.isclose(got[n], want[i], rel_tol=1e-9, abs_tol=1e-9)


def test_mixing_edges(odd):
    sized = odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.taken(sized, "size").select("doc_id", "source", "size", F.col("__mix_target").alias("t"), F.col("__mix_taken").alias("taken")).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    assert all(by[r.source] == math.floor(r.t) for r in got)
    assert mixing.taken(sized.limit(0), "size").count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_the_mix_is_in_order_of_finish_time(docs):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = sorted(mixing.served(sized, "size").collect(), key=lambda r: (r["__mix_total"]))
    total, time = 0, 0.0
    for r in got:
        total += r["__mix_taken"]
        assert r["__mix_total"] == total and r["__mix_finish"] >= time
        time = r["__mix_finish"]
    goals = {r.source: r["__mix_target"] for r in got}
    assert total == sum(map(math.floor, goals.values())) <= 1.5 * sum(r["size"] for r in sized.collect()) < total + len(goals) + 1


def test_mixed_serves_whole_documents_in_time_order(docs):
    mix = mixing.mixed(docs).collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    times = Counter(r.doc_id for r in mix)
    assert max(times.values()) <= 2
    source = {r.doc_id: r.source for r in docs.collect()}
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    goals = filled([total[s] for s in sorted(total)], [(3, 1, 2)[i % 3] for i in range(len(total))], 1.5 * sum(total.values()))
    order = {s: sorted((i for i in source if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in total}
    for k, s in enumerate(sorted(total)):
        run, want = 0, Counter()
        for i in order[s] * 2:
            run += sizes[i]
            want[i] += run <= goals[k]
        assert {i: n for i, n in want.items() if n} == {i: times[i] for i in order[s] if times[i]}


# 7. Packing


def test_best_fit_decreasing():
    rng = random.Random(10)
    for _ in range(150):
        capacity = rng.choice([1, 5, 64, 1024])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b in bins if b[0] >= n]
            if fit:
                min(fit)[0] -= n
            else:
                bins.append([capacity - n])
        used = defaultdict(list)
        for (b, offset), n in zip(packing.best_fit_decreasing(lengths, capacity), lengths):
            used[b].append((offset, n))
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == sorted(b[0] for b in bins)


def check_packing(got, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_paths()[1])
    want, places, total = Counter(), defaultdict(list), 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) % 1024 or 1024
        at = 0
        for k, n in enumerate([min(first, len(ids))] + [1024] * ((len(ids) - first) // 1024 if len(ids) > first else 0)):
            want[(i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024
    return len(places), total


def test_packing_whole_table(spark, sf_dir, docs):
    bins, total = check_packing(queries.op7_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= 1.02 * -(-total // 1024) + 1


def test_packing_edges(odd):
    check_packing(packing.packed(odd, group=2).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.packed(odd.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(packing.default_paths()[1]), random.Random(11)
    encode = packing.encoder(packing.default_paths()).encode
    letters = [chr(c) for c in [*range(9, 14), *range(0x1C, 0x260), 0x2009, 0x2019, 0x2028, 0x3000, 0x4E00, 0x1F600]]
    fast = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and packing.COMMON.fullmatch(chr(c))]
    assert len(fast) > 500
    for c in fast:
        for text in (c, f"a{c}b {c} {c}{c}1", f"{c}'s {c}a 1{c}", f"<|endoftext|>{c}"):
            assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    for n in range(4000):
        text = "".join(rng.choice(letters if n % 2 else letters[:100]) if rng.random() < 0.6 else rng.choice([" ", "a", "'s", "  ", "\n", " \n ", "1", "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


# 8. Personal data


def test_strict_spans_whole_table(spark, sf_dir, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op8_pii(spark, sf_dir).collect():
        t, want = text[r.doc_id], []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]:
                    want.append(f"{kind}:{m.start()}:{m.end()}")
        counts = Counter(w.split(":")[0] for w in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


def test_field_on_held_out_sentences():
    field, rng, right, found, there = pii.trained(), random.Random(1234), 0, 0, 0
    for _ in range(600):
        text, gold = pii.example(rng)
        got = [s for a, b in pii.islands(text) for s in field.decode(text, a, b)]
        right, found, there = right + len(set(got) & set(gold)), found + len(got), there + len(gold)
    assert right >= 0.95 * found and right >= 0.95 * there


def test_field_decodes_the_best_segmentation():
    field, rng = pii.trained(), random.Random(12)
    for _ in range(60):
        text, _ = pii.example(rng)
        n, _, candidates = field.island(text, 0, len(text))
        if not 0 < len(candidates) <= 12:
            continue
        score = field.scores(text, candidates).max(axis=1)
        best = 0.0
        for mask in range(2 ** len(candidates)):
            chosen = sorted((candidates[i][:2], score[i]) for i in range(len(candidates)) if mask >> i & 1)
            if all(a[0][1] <= b[0][0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(s for _, s in chosen))
        where = {c[2:]: i for i, c in enumerate(candidates)}
        assert math.isclose(sum(score[where[s, e]] for _, s, e in field.decode(text, 0, len(text))), best, abs_tol=1e-9)


def test_personal_data_edges(odd, spark):
    got = pii.found(odd, keep=("doc_id", "word")).collect()
    assert len(got) == len(ODD) and not any(r.spans for r in got)
    assert pii.found(odd.limit(0)).count() == 0
    text = "🙂 mail a.b@c.org, 4111 1111 1111 1111 or +49 (30) 123-4567 at 10.0.0.1; not 300.1.1.1"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, "en", "s", 0), (3, "nothing", "en", "s", 7)], DOC)
    rows = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert rows[1].text == "🙂 mail <EMAIL>, <CARD> or <PHONE> at <IP>; not 300.1.1.1" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "nothing" and pii.redacted(df).columns == df.columns


# 9. Language


def test_languages_held_out(spark, sf_dir, docs):
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.identified(docs.where("doc_id % 2 = 1"), "text", model).collect()
    assert sum(r["__text_language"] == r.lang for r in rows) >= 0.97 * len(rows)
    pages = queries.op9_langid(spark, sf_dir).collect()
    assert sum(r.language == r.declared for r in pages) >= 0.97 * len(pages)


def plain_languages(rows, model):
    """(language, confidence) of rows(text, declared, suffix, host), by dictionaries and lists."""
    n, lls, votes = len(model.languages), [], []
    for text, *_ in rows:
        ll = model.log_likelihoods(text)
        lls.append(None if ll is None else [*ll[:n], ll[n + 1]])
        if ll is None:
            votes.append([0.0] * n)
        else:
            p = [math.exp(langid.TEMPER * (x - max(ll[: n + 1]))) for x in ll[: n + 1]]
            p = [x / sum(p) for x in p]
            sure = 1 + sum(x * math.log(x) for x in p if x) / math.log(n + 1)
            size = len(langid.trigrams(text))
            votes.append([x * sure * size / (size + langid.HALF_VOTE) for x in p[:n]])
    every = [1 + sum(v[i] for v in votes) for i in range(n)]
    every = [x / sum(every) for x in every]
    sums = defaultdict(lambda: [0.0] * n)
    parts = lambda host: (host, ".".join(host.split(".")[-2:]), host.split(".")[-1])
    for (_, declared, suffix, host), v in zip(rows, votes):
        for key in (("d", declared), ("s", suffix), *zip("hmt", parts(host))):
            sums[key] = [a + b for a, b in zip(sums[key], v)]
    smooth = lambda s, to: [(a + langid.SMOOTHING * b) / (sum(s) + langid.SMOOTHING) for a, b in zip(s, to)]
    out = []
    for (_, declared, suffix, host), v, ll in zip(rows, votes, lls):
        if ll is None:
            out.append((langid.UNKNOWN, 0.0))
            continue
        h, m, t = parts(host)
        prior = smooth(sums["m", m], smooth(sums["t", t], every))
        prior = smooth([max(a - b, 0.0) for a, b in zip(sums["h", h], v)], prior)
        score = [langid.TEMPER * a + math.log(b) for a, b in zip(ll, prior)]
        for key in (("d", declared), ("s", suffix)):
            if key[1]:
                score = [a + math.log(b / c) for a, b, c in zip(score, smooth(sums[key], every), every)]
        score.append(langid.TEMPER * ll[n] + math.log(langid.UNKNOWN_PRIOR))
        best, name = max(zip(score, [*model.languages, langid.UNKNOWN]))
        out.append((name, 1 / sum(math.exp(x - best) for x in score)))
    return out


def test_fusion_against_plain_code(spark, sf_dir, docs):
    model, rows, ids = langid.fit(docs), [], []
    for r in common.read(spark, sf_dir, "pages").collect():
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r.url) or ["", ""])[1]
        path = re.match(r"[^:]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", r.url)
        declared = re.search(langid.DECLARED, r.html)
        ids.append(r.page_id)
        rows.append((langid.visible(r.html), declared[1].lower() if declared else "", host.split(".")[-1] + "/" + (path[1].lower() if path else ""), "=" + host.lower()))
    got = {r.page_id: r for r in queries.op9_langid(spark, sf_dir).collect()}
    for i, (name, sure) in zip(ids, plain_languages(rows, model)):
        assert got[i].language == name and math.isclose(got[i].confidence, sure, rel_tol=1e-6)


def test_evidence_decides_short_texts(spark, docs):
    model = langid.fit(docs)
    rows = [(i, "des", f"{k}.{k}", k, k) for i, k in enumerate(["fr", "de", "es"] * 40)] + [(900 + i, long_, h, k, k) for i, (k, h, long_) in enumerate((r.lang, f"{r.lang}.{r.lang}", r.text) for r in docs.where("lang <> 'en'").limit(60).collect())]
    df = spark.createDataFrame(rows, "i long, text string, host string, declared string, want string")
    got = langid.identified(df, "text", model, F.col("declared"), F.col("declared"), F.col("host")).collect()
    assert all(r["__language"] == r.want for r in got)


def test_language_edges(odd, docs, spark):
    model = langid.fit(docs)
    kept = langid.known_languages(odd, model)
    assert kept.columns == odd.columns
    got = {r.doc_id for r in kept.collect()}
    assert 3 in got and not got & {1, 2, 7}
    assert langid.known_languages(odd.limit(0), model).count() == 0
    assert langid.known_languages(odd, langid.fit(docs.limit(0))).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", "<html lang=de><p>die der und das ist nicht"), (2, "http://x.de/fr/1", "<html lang='de-AT'>die der und das ist nicht")], "page_id long, url string, html string")
    assert [(r.id, r.language) for r in langid.page_languages(pages, model).orderBy("id").collect()] == [(1, "und"), (2, "de"), (2, "de")]


# 10. SimHash


def slow_simhash(text, words):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile_rows,radius", [(4096, 3), (8, 3), (16, 9)])
def test_simhash_against_all_pairs(docs, tile_rows, radius):
    rows = [(r.doc_id, slow_simhash(r.text, 3)) for r in docs.collect()]
    want = classes([i for i, _ in rows], [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[:n] if (x ^ y).bit_count() <= radius])
    got = simhash.simhash_groups(docs, tile_rows=tile_rows, radius=radius).collect()
    assert {r.id: (bytes(r.fp).hex(), r.component) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in rows}


def test_simhash_tiles_lose_no_link(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(8)} | {0, 2**64 - 1, 7})
    nodes = spark.createDataFrame([(bytearray(x.to_bytes(8, "big")),) for x in fps], "fp binary")
    links = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.tile_links(nodes, 3, 1, 4, 5).collect()]
    assert all((a ^ b).bit_count() <= 3 * len(fps) for a, b in links)
    want = classes(fps, [(a, b) for n, a in enumerate(fps) for b in fps[:n] if (a ^ b).bit_count() <= 3])
    assert classes(fps, links) == want


def test_simhash_edges(odd):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    by = {r.id: r for r in got}
    assert bytes(by[1].fp) == bytes(8) and by[1].component == by[2].component == by[7].component == 1 and by[None].component == 3
    assert simhash.simhash_groups(odd.limit(0)).count() == 0
    kept = simhash.near_copies_removed(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, 6, 8])


def shingle_sets(rows, words=5):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))
    return out


def test_near_copies_are_removed_and_others_stay(spark):
    rng, rows = random.Random(14), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for _ in range(60):
        w = [word() for _ in range(rng.choice([40, 120, 400]))]
        rows.append(list(w))
        if len(rows) % 3 == 0:
            rows += [list(w), [*w[: len(w) // 2], word(), *w[len(w) // 2 :]]]  # an exact copy, and one with a word more
        if len(rows) % 4 == 0:
            rows.append(w[: len(w) // 2] + [word() for _ in range(len(w) // 2)])  # half of it new
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    s = shingle_sets(rows)
    want = classes([i for i, _ in rows], [(a, b) for a in s for b in s if b < a and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])])
    kept = {r.doc_id for r in simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in s if want[i] == i}


# The pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    stage, kept = dict(corpus_pipeline.STAGES), docs
    assert len(corpus_pipeline.STAGES) == 5
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        kept = common.durable(f(spark, kept, sf_dir))
        seen[name] = kept
        assert name == "packing" or kept.columns == docs.columns
    every = {r.doc_id: r for r in docs.collect()}
    language = {r.doc_id: r for r in seen["language_id"].collect()}
    assert set(language) == {i for i, r in every.items() if re.search("[A-Za-z]", r.text or "")}
    near = {r.doc_id for r in seen["simhash_near_dedup"].collect()}
    s = shingle_sets([(i, language[i].text) for i in language])
    links = [(a, b) for a in language for b in language if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    assert near == {i for i, c in classes(language, links).items() if i == c}
    clean = {r.doc_id: r for r in seen["pii"].collect()}
    assert set(clean) == near and all(not pii.strict_spans(r.text) for r in clean.values())
    assert all(clean[i].text == language[i].text for i in near if not pii.strict_spans(language[i].text) and "<" not in clean[i].text)
    mix = Counter(r.doc_id for r in seen["mixing"].collect())
    assert set(mix) <= near and max(mix.values()) <= 2
    check_packing(seen["packing"].collect(), [(r.doc_id, r.text) for r in seen["mixing"].collect()])
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["packing"].count()
    assert stage["packing"](spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_edges(spark, odd, sf_dir):
    kept = odd
    for name, f in corpus_pipeline.STAGES:
        kept = common.durable(f(spark, kept, sf_dir))
    assert "sequence_id" in kept.columns
    empty = odd.limit(0)
    for name, f in corpus_pipeline.STAGES:
        empty = common.durable(f(spark, empty, sf_dir))
    assert empty.count() == 0
