"""SimHash near-duplicates by a tiled exact comparison.

Every document gets a fingerprint: bit i is set if it is set in more than half of the hashes of its word shingles,
repeats counted unless `distinct` is set. Two fingerprints link if at most `radius` bits differ. All pairs of tiles of fingerprints are
compared with numpy (exclusive-or, bit count) but for those whose population counts already differ by more than the
radius. A tile holds fingerprints with like population counts in each of `parts` parts of their bits; the sum of the
parts' least differences is a lower bound of the distance, as the difference of the whole counts is.

Only distinct fingerprints are compared, so copies cost nothing. Each tile is compared with itself first, which gives
its rows a root; a pair of tiles then passes on a spanning forest of links between roots, so that a large group of near
copies leaves about one link for each pair of its tiles, never all pairs.

`near_copies_removed` takes the groups for candidates only and confirms them by the shingles themselves. It compares the
fingerprints of documents that share a band (a few least hashes of their shingles), not those of all pairs. Pairs that
these miss are then found by bounds that no near copy is beyond, among documents not joined yet.

Nulls: a null text is an empty one, whose fingerprint is zero and is compared like any other. A null id takes part as
a text and never gives its group a name; a group of only such rows has a null component. Repeated rows and ids stay.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, forget, map_batches, roots, texts

SEED = 42
#: Shingles turned into bits at a time.
CHUNK = 1 << 16
#: Pairs compared at a time.
BLOCK = 1 << 20
#: Parts into which the tiles of a crowded cell are dealt.
SALTS = 16
#: Shingles and sets of a tile of sets that are compared with each other.
TILE_SHINGLES, TILE_SETS = 1 << 19, 2048
#: Bands of a document and least hashes in each: sets of similarity 0.8 share one but for 1 in 100,000.
BANDS, ROWS = 16, 3
#: Fingerprints of a band whose pairs are compared together with those of other bands.
SMALL = 8
#: Buckets of shingles whose counts give the order of a set's shingles, rare ones first; any order finds the same pairs.
BUCKETS, SLICES = 1 << 18, 256
#: Shingles that are sent to all tasks at once; more of them are joined by a shuffle.
SENT = 1 << 20
#: Words of 64 bits of a set's parities.
PARITIES = 16
#: A hash in more sets than FEW is counted by matrix products, WIDTH hashes at a time.
FEW, WIDTH = 24, 2048


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words; the whole sequence if it is shorter, nothing if it has no word."""
    w = text.lower().split()
    if len(w) > words:
        shingles = zip(*(w[i:] for i in range(words)))
    else:
        shingles = [w] if w else []
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(b" ".join(s), SEED) for s in shingles], np.uint64)


def widen(h: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes, and further lanes of 64 bits derived from them by the splitmix64 finaliser."""
    out = [h]
    for lane in range(1, lanes):
        z = h + np.uint64((0x9E3779B97F4A7C15 * lane) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Majority of each bit over all hashes, as lanes of 64 bits."""
    ones = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), CHUNK):
        part = widen(h[i : i + CHUNK], lanes)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """Keys of BANDS bands, each of the least ROWS of that many orders of the shingles' hashes; none without shingles."""
    if not len(h):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(SEED)
    flip, odd = (rng.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), CHUNK // 8):
        least = np.minimum(least, ((h[i : i + CHUNK // 8, None] ^ flip) * (odd | np.uint64(1))).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for own in least.reshape(BANDS, ROWS).T:
        key = (key ^ own) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many rows hold a shingle, by the bucket of its hash; summed in slices, so that no task has all of a large job."""
    per = BUCKETS // SLICES

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in texts(batch.column(0)):
                np.add.at(total, (np.unique(shingle_hashes(t, words)) % np.uint64(BUCKETS)).astype(np.int64), 1)
        held = [x.tobytes() for x in total.reshape(SLICES, per)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(held, pa.binary())], ["slice", "held"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for x in table["held"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": table["slice"][:1], "held": pa.array([total.tobytes()], pa.binary())})

    schema, total = "slice int, held binary", np.zeros((SLICES, per), np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect():
        total[r["slice"]] = np.frombuffer(bytes(r["held"]), np.int64)
    return np.minimum(total.ravel(), 2**31 - 1).astype(np.int32)


def prefix(h: np.ndarray, counts: np.ndarray, least: Fraction) -> np.ndarray:
    """The first of a set's hashes by their buckets' counts: two sets at a similarity of `least` share one of these.

    They share at least n * least of either set's n hashes, in one order for all; what is left of it after the prefix is less.
    """
    order = np.lexsort((h, counts[(h % np.uint64(BUCKETS)).astype(np.int64)]))
    return h[order[: len(h) + 1 + -len(h) * least.numerator // least.denominator]].view(np.int64) if len(h) else np.zeros(0, np.int64)


def parities(h: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each of 64 * PARITIES places: sets with d hashes not shared differ in d bits at most."""
    places = np.bincount(((h >> np.uint64(20)) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((places & 1).astype(np.uint8)).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int = 1, distinct: bool = False, *more, banded: tuple[np.ndarray, Fraction] | None = None) -> DataFrame:
    """(id, fp, n) and the columns `more`: fp holds the lanes as big-endian bytes, so that its hexadecimal form is the
    fingerprint's; n is the number of shingles. banded: `bands`, `prefix` by these counts and similarity, and `parity` as well."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes, keys, firsts, odd = [], [], [], [], []
        for t in texts(batch.column("__text")):
            h = shingle_hashes(t, words)
            h = np.unique(h) if distinct else h
            fps.append(fingerprint(h, lanes).astype(">u8").tobytes())
            sizes.append(len(h))
            if banded:
                keys.append(bands(h))
                firsts.append(prefix(h, *banded))
                odd.append(parities(h))
        rest = [n for n in batch.schema.names if n != "__text"]
        held, names = [*(batch.column(n) for n in rest), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], [*rest, "fp", "n"]
        if banded:
            held += [*(pa.array(x, pa.list_(pa.int64())) for x in (keys, firsts)), pa.array(odd, pa.binary())]
            names += ["bands", "prefix", "parity"]
        return pa.RecordBatch.from_arrays(held, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), *more, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, fp binary, n long" + (", bands array<long>, prefix array<long>, parity binary" if banded else ""))


def neighbours(radius: int, parts: int, base: int, bin: int = 1) -> list[int]:
    """Steps from a tile's key to those of the tiles within the radius, each unordered pair of tiles once.

    Counts whose bins are k > 0 apart differ by (k - 1) * bin + 1 at least.
    """
    reach = range(-(radius // bin) - 1, radius // bin + 2)
    least = lambda s: sum((abs(k) - 1) * bin + 1 for k in s if k)
    steps = (s for s in product(reach, repeat=parts) if least(s) <= radius and s >= (0,) * parts)
    return [sum(d * base ** (parts - 1 - i) for i, d in enumerate(s)) for s in steps]


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between the rows of a and b (numbered on from a's) at most radius bits apart.

    tops: a row that stands for each of a's and b's rows, which is linked in its place.
    """
    n, left, right = len(a), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, BLOCK // max(1, len(b)))
    # The fewest lanes in which unrelated rows, whose bits differ by half, hardly ever pass.
    half = next((k for k in range(1, a.shape[1]) if 32 * k - 16 * k**0.5 > radius), a.shape[1])
    for i in range(0, n, step):
        apart = np.bitwise_count(a[i : i + step, None, 0] ^ b[None, :, 0]).astype(np.uint16)
        for lane in range(1, half):
            apart += np.bitwise_count(a[i : i + step, None, lane] ^ b[None, :, lane])
        x, y = np.nonzero(apart <= radius)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        if half < a.shape[1]:
            close = np.bitwise_count(a[x] ^ b[y]).sum(axis=1, dtype=np.int64) <= radius
            x, y = x[close], y[close]
        if len(x):
            y = y if same else y + n
            x, y = (x, y) if tops is None else (tops[x], tops[y])
            top = roots_of(n + (0 if same else len(b)), x, y)
            left.append(top[0])
            right.append(top[1])
    x, y = np.concatenate(left), np.concatenate(right)
    return roots_of(n + (0 if same else len(b)), x, y)


def roots_of(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = roots(n, x, y)
    below = np.nonzero(top != np.arange(n))[0]
    return below, top[below]


def unpacked(fps: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), lanes)


def link_batch(left: list[bytes], right: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def rooted_tiles(made: DataFrame, radius: int, lanes: int) -> DataFrame:
    """made(cell, chunk, fps) with tops: for each fingerprint of a tile the place of the one that stands for it."""

    def rooted(batch: pa.RecordBatch) -> pa.RecordBatch:
        tops = []
        for fps in batch.column(2):
            x = unpacked(fps.as_py(), lanes)
            below, top = compare(x, x, radius, True)
            own = np.arange(len(x), dtype=np.int32)
            own[below] = top
            tops.append(own)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.list_(pa.int32()))], ["cell", "chunk", "fps", "tops"])

    return durable(map_batches(made, rooted, f"cell {made.schema['cell'].dataType.simpleString()}, chunk long, fps array<binary>, tops array<int>"), "tiles")


def tops_linked(tiles: DataFrame) -> DataFrame:
    """(a, b): each fingerprint of a tile with the one that stands for it."""
    return tiles.select(F.posexplode("tops").alias("at", "top"), "fps").where("at <> top").select(F.get("fps", "at").alias("a"), F.get("fps", "top").alias("b"))


def across_tiles(pairs: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b): a spanning forest of the links between what stands for the rows of pairs(own_fps, own_tops, fps, tops)."""

    def across(batch: pa.RecordBatch):
        for own, own_tops, other, tops in zip(*(batch.column(i) for i in range(4))):
            own, other = own.as_py(), other.as_py()
            rows = np.concatenate([own_tops.values.to_numpy(), tops.values.to_numpy() + len(own)])
            below, top = compare(unpacked(own, lanes), unpacked(other, lanes), radius, False, rows)
            if len(below):
                every = own + other
                yield link_batch([every[i] for i in below], [every[i] for i in top])

    return map_batches(pairs.select("own_fps", "own_tops", "fps", "tops"), across, "a binary, b binary")


def forest(fps: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Links of a spanning forest of those between the rows left[i] and right[i], each to the least fingerprint reached."""
    coded = fps.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at, names = rank[coded.indices.to_numpy()], coded.dictionary.take(order)
    return pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in roots_of(len(order), at[left], at[right])], ["a", "b"])


def tile_links(nodes: DataFrame, radius: int, lanes: int, parts: int, tile_rows: int) -> DataFrame:
    """(a, b): fingerprints linked within the radius, as spanning forests of tiles and of pairs of tiles.

    nodes: distinct (fp). One part has bins of half the radius, more of them bins of one count. Binned counts have at most
    (64 * lanes / parts + 1) ** parts values, which bounds the table of tile sizes that is broadcast, however many
    fingerprints there are. A cell with many tiles is dealt by its tiles' numbers into up to SALTS parts.
    """
    width, bin = 64 * lanes // parts, max(1, radius // 2) if parts == 1 else 1
    per, base = width // 8, width // bin + 1
    key = F.lit(0)
    for p in range(parts):
        key = key * base + F.floor(sum_bits(F.expr(f"substring(fp, {p * per + 1}, {per})"), per) / bin).cast("int")
    keyed = nodes.select("fp", key.alias("cell"))
    sizes = durable(keyed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("chunks")), "sizes")
    salts = min(SALTS, sizes.agg(F.max("chunks")).first()[0] or 1)
    chunked = keyed.join(F.broadcast(sizes), "cell").select("cell", F.expr("pmod(xxhash64(fp), chunks)").alias("chunk"), "fp")

    made = chunked.groupBy("cell", "chunk").agg(F.collect_list("fp").alias("fps"))
    tiles = rooted_tiles(made, radius, lanes)

    steps = F.explode(F.array(*[F.lit(s) for s in neighbours(radius, parts, base, bin)]))
    left = tiles.select(*[F.col(c).alias(f"own_{c}") for c in tiles.columns], steps.alias("step"), F.pmod("chunk", F.lit(salts)).alias("salt")).withColumn("other", F.col("own_cell") + F.col("step"))
    right = tiles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = left.join(right, (F.col("other") == F.col("cell")) & (F.col("salt") == F.col("part")) & ((F.col("step") != 0) | (F.col("own_chunk") < F.col("chunk"))))

    return tops_linked(tiles).union(across_tiles(pairs, radius, lanes))


def band_links(keyed: DataFrame, radius: int, lanes: int, tile_rows: int) -> DataFrame:
    """(a, b): fingerprints within the radius among those of a band, keyed(fp, cell) being distinct.

    Bands that are compared together leave a spanning forest of their links, not a link a band. A band of more than
    tile_rows fingerprints is dealt into tiles, which are linked as in tile_links.
    """
    sizes = durable(keyed.groupBy("cell").count().where(F.col("count") > tile_rows).select(F.col("cell").alias("large"), F.ceil(F.col("count") / tile_rows).cast("int").alias("chunks")), "sizes")
    rows = keyed.join(F.broadcast(sizes), F.col("cell") == F.col("large"), "left").select("cell", "fp", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    fps = F.collect_list("fp").alias("fps")
    whole = rows.where("chunks = 1").groupBy("cell").agg(fps).where("size(fps) > 1").select("fps")

    def within(batch: pa.RecordBatch):
        lists = batch.column(0)
        size, every = pc.list_value_length(lists).to_numpy(), lists.flatten()
        x, of = unpacked(every.to_pylist(), lanes), np.repeat(size, size)
        own, left, right = np.repeat(np.arange(len(size)), size), [], []
        for d in range(1, SMALL):
            i = np.nonzero((own[d:] == own[:-d]) & (of[d:] <= SMALL))[0]
            i = i[np.bitwise_count(x[i] ^ x[i + d]).sum(axis=1, dtype=np.int64) <= radius]
            left.append(i)
            right.append(i + d)
        starts = np.cumsum(size) - size
        for k in np.nonzero(size > SMALL)[0]:
            part = x[starts[k] : starts[k] + size[k]]
            below, top = compare(part, part, radius, True)
            left.append(below + starts[k])
            right.append(top + starts[k])
        yield forest(every, np.concatenate(left), np.concatenate(right))

    found = map_batches(whole, within, "a binary, b binary")
    if sizes.isEmpty():
        return found.distinct()
    tiles = rooted_tiles(rows.where("chunks > 1").groupBy("cell", F.expr("pmod(xxhash64(fp), chunks)").alias("chunk")).agg(fps), radius, lanes)
    left = tiles.select(*[F.col(c).alias(f"own_{c}") for c in tiles.columns])
    pairs = left.join(tiles, (F.col("own_cell") == F.col("cell")) & (F.col("own_chunk") < F.col("chunk")))
    return found.union(tops_linked(tiles)).union(across_tiles(pairs, radius, lanes)).distinct()


def sum_bits(binary, size: int):
    """Set bits of a binary column of `size` bytes, at most 8 at a time."""
    total = F.lit(0)
    for i in range(0, size, 4):
        n = min(4, size - i)
        total = total + F.bit_count(F.conv(F.hex(F.substring(binary, i + 1, n)), 16, 10).cast("long"))
    return total


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, lanes: int = 1, tile_rows: int = 4096, distinct: bool = False) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links, its own included.

    words: words of a shingle. lanes: words of 64 bits of a fingerprint. radius: most bits by which linked ones differ.
    distinct: repeats of a shingle count once. Groups are found among fingerprints and named afterwards, so that rows with
    a null id link others, too.
    """
    return groups_of(durable(fingerprints(docs, id_col, text_col, words, lanes, distinct), "fps"), radius, lanes, tile_rows)


def groups_of(fps: DataFrame, radius: int, lanes: int, tile_rows: int) -> DataFrame:
    """(id, fp, component) of rows(id, fp)."""
    reps = durable(fps.groupBy("fp").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "reps")
    found = fingerprint_components(reps, radius, lanes, tile_rows)
    linked = found.join(reps.select("node", "rep"), "node")
    names = linked.join(linked.groupBy("component").agg(F.min("rep").alias("name")), "component").select(F.col("node").alias("of"), "name")
    labels = durable(reps.join(names, reps.node == names.of, "left").select(F.col("fp").alias("of"), F.coalesce("name", "rep").alias("component")), "labels")
    forget(reps)
    return fps.join(labels, fps.fp == labels.of).select("id", "fp", "component")


def fingerprint_components(reps: DataFrame, radius: int, lanes: int, tile_rows: int) -> DataFrame:
    """(node, component) of the linked ones of reps(fp, node), whose fp are distinct.

    Few bits let tiles be cut by the counts of four parts; a radius beyond a part's spread leaves one part.
    """
    return linked_nodes(reps, tile_links(reps.select("fp"), radius, lanes, 4 if radius <= 4 * lanes else 1, tile_rows))


def linked_nodes(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of reps(fp, node) that links(a, b) between their fp join."""
    links = durable(links, "links")
    a, b = reps.select(F.col("fp").alias("a"), F.col("node").alias("na")), reps.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
    found = components(links.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    forget(links)
    return found


def exact_links(sets: list[np.ndarray], left: int, least: Fraction, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between sets of shingle hashes whose Jaccard similarity is `least` or more.

    left: if not 0, only sets before it are held against those from it on. Two empty sets are equal. What two sets share
    is counted hash by hash: from all pairs of the few sets that hold a rare one, and by products of 0-1 matrices for the
    others, of which there are few. tops: a number below n that stands for each set, which is linked in its place.
    """
    n = len(sets)
    up, across = (left, n - left) if left else (n, n)
    size = np.fromiter(map(len, sets), np.int64, n)
    hashes, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    col, row = at[order], np.repeat(np.arange(n), size)[order]
    held = count[col]
    both = np.zeros(up * across, np.int64)
    few = (held > 1) & (held <= FEW)
    c, r = col[few], row[few]
    for d in range(1, int(held[few].max(initial=1))):
        same = c[d:] == c[:-d]
        x, y = r[:-d][same], r[d:][same]  # x < y: the sort is stable
        if left:
            cross = (x < left) & (y >= left)
            x, y = x[cross], y[cross] - left
        both += np.bincount(x * across + y, minlength=len(both))
    both = both.reshape(up, across)
    c, r = np.unique(col[held > FEW], return_inverse=True)[1], row[held > FEW]
    for first in range(0, int(c.max(initial=-1)) + 1, WIDTH):
        now = (c >= first) & (c < first + WIDTH)
        block = np.zeros((n, WIDTH), np.float32)
        block[r[now], c[now] - first] = 1
        both += (block[:up] @ (block[left:] if left else block).T).astype(np.int64)
    union = size[:up, None] + (size[left:] if left else size)[None, :] - both
    close = both * least.denominator >= union * least.numerator
    if not left:
        close[np.tril_indices(n)] = False
    x, y = np.nonzero(close)
    y += left
    return roots_of(n, x, y) if tops is None else roots_of(n, tops[x], tops[y])


def confirmed(members: DataFrame, docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(a, b): links that hold by the shingles themselves, as spanning forests, between nodes of one cluster.

    members(node, cluster, id, k1, k2, n): one row each, n being its shingles. docs(id, k1, k2, text) has their texts. A
    cluster beyond TILE_SHINGLES shingles or TILE_SETS sets is dealt into tiles, and each pair of them is compared; small
    clusters share a task's group. Each tile is compared with itself first, so that a pair of tiles passes on links only
    between the nodes that stand for others there, about one for each pair of a large group's tiles.
    """
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_SETS), F.lit(1)).cast("int").alias("tiles"), F.sum("n").alias("all"))
    sizes = durable(sizes, "sizes")
    bins = 1 + (sizes.where("tiles = 1").agg(F.sum("all")).first()[0] or 0) // TILE_SHINGLES
    shared = F.when(F.col("tiles") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster"))
    known = members.join(sizes, "cluster").select("node", "cluster", "tiles", shared.alias("bin"), F.col("id").alias("of"), F.col("k1").alias("l1"), F.col("k2").alias("l2"))
    known = durable(known, "known")  # of known size, so that texts stay where they are if these are few
    match = docs["id"].eqNullSafe(known["of"]) & (docs["k1"] == known["l1"]) & (docs["k2"] == known["l2"])
    found = docs.join(known, match).groupBy("of", "l1", "l2", "node").agg(F.first("text").alias("text"), *[F.first(x).alias(x) for x in ("cluster", "tiles", "bin")])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in texts(batch.column("text"))], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("node", "cluster", "tiles", "bin")), held], ["node", "cluster", "tiles", "bin", "shingles"])

    packed = durable(map_batches(found.select("node", "cluster", "tiles", "bin", "text"), pack, "node long, cluster long, tiles int, bin long, shingles binary"), "shingles")
    dealt = packed.withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        cluster, right, node, stands = (table[x].to_numpy() for x in ("cluster", "right", "node", "top"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        order = np.lexsort((node, right, cluster))
        cuts = np.nonzero(np.diff(cluster[order], prepend=order.size and cluster[order[0]] - 1))[0]
        apart = table["x"][0].as_py() != table["y"][0].as_py()
        below, top = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            own = order[a:b]
            left = int((~right[own]).sum()) if apart else 0
            if len(own) > 1 and (not apart or 0 < left < len(own)):
                names, tops = np.unique(stands[own], return_inverse=True)
                i, j = exact_links([sets[k] for k in own], left, least, tops)
                below.append(names[i])
                top.append(names[j])
        return pa.table({"a": np.concatenate(below), "b": np.concatenate(top)})

    def compared(rows: DataFrame) -> DataFrame:
        sides = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right")
        return rows.select("bin", "cluster", *sides, "node", "top", "shingles").groupBy("bin", "x", "y").applyInArrow(compare, "a long, b long")

    inner = compared(dealt.withColumns({"other": F.col("own"), "top": F.col("node")}))
    if sizes.where("tiles > 1").isEmpty():
        return inner
    inner = durable(inner, "inner")
    stood = dealt.where("tiles > 1").join(inner.withColumnRenamed("a", "of"), F.col("node") == F.col("of"), "left").withColumn("top", F.coalesce("b", "node"))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return inner.union(compared(stood.select("*", others).where("own <> other")))


def likely_links(rows: pa.StructArray, spans: list[tuple[int, int, int, int]], small: np.ndarray, least: Fraction) -> pa.RecordBatch:
    """Links of a spanning forest between nodes of different groups whose sets can have a similarity of `least`.

    rows(node, grp, n, pos, parity): a set of n shingles that has a cell's shingle at place pos of its order. spans: rows
    a to b are held against c to d, those within a span once a pair. small: the sizes of cells of the first rows, of up to SMALL rows, all
    pairs of which are compared. Of two sets whose first shared shingle this is, min(n - pos) are shared at most, and
    n + n - 2 * shared of parities differ at most, so that no pair at `least` is left out.
    """
    node, group, n, pos = (rows.field(i).to_numpy().astype(np.int64) for i in range(4))
    odd, rest = unpacked(rows.field(4).to_pylist(), PARITIES), n - pos
    num, both = least.numerator, least.numerator + least.denominator
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(x: np.ndarray, y: np.ndarray):
        for i in range(0, len(x), CHUNK):
            a, b = x[i : i + CHUNK], y[i : i + CHUNK]
            apart = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
            close = apart * both <= (both - 2 * num) * (n[a] + n[b])
            left.append(a[close])
            right.append(b[close])

    of = np.repeat(np.arange(len(small)), small)
    for d in range(1, SMALL):
        x = np.nonzero(of[d:] == of[:-d])[0]
        y = x + d
        now = (group[x] != group[y]) & (np.minimum(rest[x], rest[y]) * both >= num * (n[x] + n[y]))
        take(x[now], y[now])
    for a, b, c, d in spans:
        step = max(1, BLOCK // 4 // (d - c))
        for i in range(a, b, step):
            j = min(b, i + step)
            now = (group[i:j, None] != group[None, c:d]) & (np.minimum(rest[i:j, None], rest[None, c:d]) * both >= num * (n[i:j, None] + n[None, c:d]))
            x, y = np.nonzero(now)
            x, y = x + i, y + c
            once = x < y
            take(x[once], y[once])
    names, at = np.unique(node, return_inverse=True)
    below, top = roots_of(len(names), at[np.concatenate(left)], at[np.concatenate(right)])
    return pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[top])], ["a", "b"])


def unjoined(sets: DataFrame, least: Fraction, tile_rows: int) -> DataFrame:
    """(a, b): links between all of sets(node, grp, n, prefix, parity) of different groups that can have a similarity of
    `least`, as spanning forests.

    Sets meet at each shingle that is in both prefixes, unless all that have it there are of one group. A shingle of more
    than tile_rows sets is dealt into tiles, all pairs of which are compared.
    """
    rows = sets.select("node", "grp", "n", F.posexplode("prefix").alias("pos", "shingle"))
    met = rows.groupBy("shingle").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("rows")).where("low <> high")
    met = durable(met.select(F.col("shingle").alias("cell"), F.ceil(F.col("rows") / tile_rows).cast("int").alias("chunks")), "met")
    met = F.broadcast(met) if met.count() <= SENT else met
    odd = sets.select(F.col("node").alias("of"), "parity")
    found = rows.join(met, F.col("shingle") == F.col("cell")).join(odd, F.col("node") == F.col("of"))
    each = F.collect_list(F.struct("node", "grp", "n", "pos", "parity")).alias("held")
    tiles = durable(found.groupBy("cell", "chunks", F.expr("pmod(xxhash64(node), chunks)").alias("chunk")).agg(each), "tiles")

    def within(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(0)
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        order = np.argsort(size > SMALL, kind="stable")
        size, lists = size[order], lists.take(pa.array(order))
        starts, few = np.cumsum(size) - size, size <= SMALL
        return likely_links(lists.flatten(), [(a, a + k, a, a + k) for a, k in zip(starts[~few], size[~few])], size[few], least)

    def across(batch: pa.RecordBatch):
        for own, other in zip(batch.column(0), batch.column(1)):
            m, k = len(own), len(other)
            yield likely_links(pa.concat_arrays([own.values, other.values]), [(0, m, m, m + k)], np.zeros(0, np.int64), least)

    inner = map_batches(tiles.where("size(held) > 1").select("held"), within, "a long, b long")
    large = tiles.where("chunks > 1")
    if large.isEmpty():
        return inner
    others = large.select(F.col("cell").alias("c"), F.col("chunk").alias("k"), F.col("held").alias("other"))
    pairs = large.join(others, (F.col("cell") == F.col("c")) & (F.col("chunk") < F.col("k"))).select("held", "other")
    return inner.union(map_batches(pairs, across, "a long, b long"))


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, lanes: int = 4, radius: int = 64, tile_rows: int = 4096) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id, null last.

    Near copies have sets of `words`-word shingles with a Jaccard similarity of `least` or more, and so do groups by a
    chain of them. SimHash finds the candidates: with 256 bits, the share of differing bits is the angle between two
    documents' shingle sets over pi, and a similarity of 0.8 means 39 bits on average (standard deviation 6), so that a
    radius of 64 is more than four deviations beyond. Only fingerprints of documents that share a band are compared, so
    that the work grows with the input: of pairs at 0.8, one in 100,000 shares none of BANDS bands of ROWS least hashes.
    What it joins into clusters is then confirmed by the shingles. Whatever fingerprints and bands miss is found by
    `unjoined`, which leaves out no pair at `least`, and confirmed in the same way, so that the result is exact but for
    equal hashes of different shingles.
    Rows with equal texts are near copies, too, whatever their shingles; of rows with the same id and text, one stays.
    """
    share = Fraction(least).limit_denominator(10**6)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(SEED), text)}
    rows = fingerprints(docs, id_col, text_col, words, lanes, True, *[c.alias(k) for k, c in keys.items()], banded=(bucket_counts(docs, text_col, words), share))
    held = "bands", "prefix", "parity"
    rows = durable(rows.groupBy("id", "k1", "k2").agg(*[F.first(c).alias(c) for c in ("fp", "n", *held)], F.count("*").alias("repeats")), "fps")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "n", "repeats", *held)).alias("v")
    nodes = durable(rows.groupBy("k1", "k2").agg(best).select("k1", "k2", "v.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    forget(rows)
    reps = durable(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("same")), "reps")
    near = linked_nodes(reps, band_links(nodes.select("fp", F.explode("bands").alias("cell")).distinct(), radius, lanes, tile_rows))
    clusters = reps.join(near.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").where("component is not null or same > 1")
    clusters = durable(clusters.select("fp", F.coalesce("component", "node").alias("cluster")), "clusters")
    members = durable(nodes.join(clusters, "fp").select("node", "cluster", "id", "k1", "k2", "n"), "members")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *[c.alias(k) for k, c in keys.items()], text.alias("text"))
    links = durable(confirmed(members, keyed, words, share), "links")
    found = components(links).withColumnRenamed("node", "of")
    joined = nodes.join(found, nodes.node == found.of, "left").select("node", F.coalesce("component", "node").alias("grp"), "n", "prefix", "parity")
    missed = components(unjoined(joined, share, tile_rows)).select(F.col("node").alias("of"), F.col("component").alias("cluster"))
    others = durable(nodes.join(missed, nodes.node == missed.of).select("node", "cluster", "id", "k1", "k2", "n"), "members")
    if not others.isEmpty():
        found = components(links.union(durable(confirmed(others, keyed, words, share), "links"))).withColumnRenamed("node", "of")
    member = nodes.join(found, nodes.node == found.of).select("component", "node", F.struct("none", "id", "k1", "k2").alias("v"))
    losers = member.join(member.groupBy("component").agg(F.min("v").alias("first")), "component").where("v <> first").select("node")
    keep = durable(nodes.join(losers, "node", "left_anti").select(F.col("id").alias("__id"), F.col("k1").alias("__l1"), F.col("k2").alias("__l2"), "repeats"), "keep")
    match = lambda d: F.col(id_col).cast("long").eqNullSafe(d["__id"]) & (F.col("__k1") == d["__l1"]) & (F.col("__k2") == d["__l2"])
    kept = docs.withColumns({f"__{k}": c for k, c in keys.items()})
    once, often = keep.where("repeats = 1"), keep.where("repeats > 1")
    out = kept.join(once, match(once), "left_semi")
    if not often.isEmpty():
        out = out.unionByName(kept.join(often, match(often), "left_semi").dropDuplicates([id_col, "__k1", "__k2"]))
    return out.select(*docs.columns)
