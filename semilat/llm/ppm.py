"""Prediction by partial matching: a pretrained byte-context table gives each document's log10 probability.

A document is its bytes, with A-Z in lower case and white space as it stands, and an end symbol. A symbol's context is
what precedes it in the document, at most `order` bytes. The table counts the symbols seen in each context over all
training documents. A symbol is coded in its longest known context; where it was never seen there, an escape is coded
(method C: as often as the context has distinct symbols) and the context is cut by its first byte, all symbols of the
longer context being excluded from the counts; after the empty context, the symbols never seen are equally likely. The
order is the same at every size.

Scale: (context, symbol) pairs are counted by grouped aggregation and stay a table. They are dealt by the last LOW bytes
of the context, so that all longer contexts a symbol can be coded in lie in one part; each part prices its own pairs.
Orders below LOW are one table for all executors, bounded by the alphabet (SYMBOLS ** LOW pairs) and not by the input. The
documents' symbols are priced by a broadcast of the at most `hot_pairs` most frequent pairs; all others are joined with
the priced table, so that the bound changes no result. Words, for base_score and n_known, go the same way by `hot`.

Nulls: a null text is an empty one, which has the end symbol only; a null id counts as an empty one, which is a training
row. Repeated rows count each. Texts are coded whole, whatever their length. With no training document every word is
unknown and all symbols are equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, map_batches, texts

ORDER, HOT, LONGEST_HOT = 6, 1 << 18, 40
LOW, HOT_PAIRS = 3, 1 << 20
#: The end of a text, as a symbol and as a token: a byte that UTF-8 never holds, so that all bytes and it are SYMBOLS.
END = b"\xff"
SYMBOLS = 256
#: Bytes of texts, or symbols, handled at a time, and pairs that a task holds before the rarest leave.
CHUNK, KEPT = 1 << 19, 1 << 21
#: Chunks whose words are looked up at once: each look-up lays out its table of listed words anew.
WIDE = 8
#: Pairs that leave a task at a time: what leaves at once is held by the worker and by its executor.
LEAVE = 1 << 16
#: Pairs priced in one part.
PART = 1 << 20
DEPTH, HELD = 56, 60
PAIR = (1 << DEPTH) - 1


def tagged(depth: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Depth and key as one sortable number: keys have at most 7 bytes."""
    return key | (depth.astype(np.uint64) << np.uint64(56))


def total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[1:] != keys[:-1]
    first = np.nonzero(begins)[0]
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def added(keys: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, with the keys that wait counted in; the list is emptied."""
    more = np.concatenate(waiting)
    waiting.clear()
    more, n = np.unique(more, return_counts=True)
    at = np.searchsorted(keys, more)
    known = np.append(keys, np.uint64(0))[at] == more
    known &= at < len(keys)
    counts[at[known]] += n[known]
    at, more, n = at[~known], more[~known], n[~known]
    return np.insert(keys, at, more), np.insert(counts, at, n)


class Trie:
    """Counts by order, from counts of (depth, context and symbol) at the greatest depth that each symbol has."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: Trie | None = None):
        """low: a trie that has the lowest orders, if the counts are only those of some longer contexts."""
        depth, key = keys >> np.uint64(56), keys & np.uint64((1 << 56) - 1)
        self.order = order
        self.nodes, self.count, self.contexts, self.sums, self.kinds = ([*x] for x in (low.nodes, low.count, low.contexts, low.sums, low.kinds)) if low else ([], [], [], [], [])
        for k in range(len(self.nodes), order + 1):
            at, n = total(key[depth >= k] & np.uint64((1 << 8 * (k + 1)) - 1), counts[depth >= k])
            context, first = np.unique(at >> np.uint64(8), return_index=True)
            self.nodes.append(at)
            self.count.append(n)
            self.contexts.append(context)
            self.sums.append(np.add.reduceat(n, first) if len(n) else n)
            self.kinds.append(np.diff(np.append(first, len(at))))
        self.rest_sum, self.rest_kinds = ([*low.rest_sum], [*low.rest_kinds]) if low else ([None], [None])  # of a context's suffix, without the context's symbols
        for k in range(len(self.rest_sum), order + 1):
            own, suffix = self.contexts[k], self.nodes[k] & np.uint64((1 << 8 * k) - 1)
            shared = self.count[k - 1][np.searchsorted(self.nodes[k - 1], suffix)]
            first = np.searchsorted(self.nodes[k] >> np.uint64(8), own)
            less = np.add.reduceat(shared, first) if len(shared) else shared
            up = np.searchsorted(self.contexts[k - 1], own & np.uint64((1 << 8 * (k - 1)) - 1))
            self.rest_sum.append(self.sums[k - 1][up] - less)
            self.rest_kinds.append(self.kinds[k - 1][up] - self.kinds[k])

    def cost(self, depth: np.ndarray, key: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out, longer = np.zeros(len(key)), np.full(len(key), -1)
        todo = np.arange(len(key))
        for k in range(self.order, -1, -1):
            now = todo[depth[todo] >= k]
            node = key[now] & np.uint64((1 << 8 * (k + 1)) - 1)
            known, at = find(self.contexts[k], node >> np.uint64(8))
            now, node, at = now[known], node[known], at[known]
            came = longer[now] >= 0
            s, d = self.sums[k][at], self.kinds[k][at]
            if k < self.order and came.any():
                s[came], d[came] = self.rest_sum[k + 1][longer[now[came]]], self.rest_kinds[k + 1][longer[now[came]]]
            seen, place = find(self.nodes[k], node)
            out[now[seen]] += np.log10(self.count[k][place[seen]] / (s[seen] + d[seen]))
            escapes = ~seen & (d > 0)
            out[now[escapes]] += np.log10(d[escapes] / (s[escapes] + d[escapes]))
            longer[now] = at
            done = np.zeros(len(key), bool)
            done[now[seen]] = True
            todo = todo[~done[todo]]
        out[todo] -= np.log10(max(1, SYMBOLS - len(self.nodes[0])))
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts with A-Z in lower case, and the row that each stands in."""
    # Lowered as bytes into a column of its own: pc.ascii_lower reads a slice of a large column at the wrong place.
    lowered = pa.array([t.lower() for t in texts(column)], pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(lowered)
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).cast(pa.large_binary()).cast(pa.binary()), row[full.to_numpy(zero_copy_only=False)]


def word_counts(rows: DataFrame) -> DataFrame:
    """rows(text, held_out) to (word, c, seen): occurrences in training documents and in all."""

    def run(batch: pa.RecordBatch):
        for part in slices(batch, 16 * CHUNK):
            for held in (False, True):
                texts_ = part.column("text").filter(pc.equal(part.column("held_out"), held))
                if len(texts_):
                    found = words_of(texts_)[0].value_counts()
                    words, n = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), np.append(found.field("counts").to_numpy(), len(texts_))
                    yield pa.RecordBatch.from_arrays([words, pa.array(n * (not held)), pa.array(n)], ["word", "c", "seen"])
                    del texts_, found, words, n
                    pa.default_memory_pool().release_unused()

    return map_batches(rows.select("text", "held_out"), run, "word binary, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def listed_words(batch: pa.RecordBatch, listed: pa.Array):
    """For each of slices(batch): it, its words and an end for each text by row, their rows, and their places in `listed` or null."""
    for wide in slices(batch, WIDE * CHUNK):
        word, row = words_of(wide.column("text"))
        word, row = pa.concat_arrays([word, pa.array([END] * len(wide), pa.binary())]), np.append(row, np.arange(len(wide)))
        order = np.argsort(row, kind="stable")
        word, row = word.take(pa.array(order)), row[order]
        at = pc.index_in(word, value_set=listed)
        del order
        pa.default_memory_pool().release_unused()
        begin = 0
        for part in slices(wide):
            first, end = np.searchsorted(row, [begin, begin + len(part)])
            yield part, word.slice(first, end - first), row[first:end] - begin, at.slice(first, end - first)
            begin += len(part)


def slices(batch: pa.RecordBatch, size: int = 0):
    """Parts of the batch with about `size` (CHUNK) bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = min(len(sizes), int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (size or CHUNK))) + 1)
        yield batch.slice(at, end - at)
        at = end


def framed(text: bytes) -> bytes:
    return text.lower() + END


def coded(pieces: list[tuple[int, bytes, int]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of (document, bytes, first symbol to code): its document, and depth, context and symbol as one number."""
    doc, data, first = zip(*pieces)
    size = np.fromiter(map(len, data), np.int64, len(data))
    buf = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts = np.cumsum(size) - size
    place = np.arange(len(buf)) - np.repeat(starts, size)
    key = buf.copy()
    for k in range(1, min(order, len(buf) - 1) + 1):
        key[k:] |= buf[:-k] << np.uint64(8 * k)
    depth = np.minimum(place, order)
    young = np.nonzero(place < order)[0]  # their context begins with the text
    key[young] &= (np.uint64(1) << (np.uint64(8) * (place[young] + 1).astype(np.uint64))) - np.uint64(1)
    every = np.repeat(doc, size)
    if any(first):
        own = place >= np.repeat(first, size)
        return every[own], tagged(depth, key)[own]
    return every, tagged(depth, key)


def symbols(frames, order: int):
    """coded() of all symbols in order, about CHUNK bytes at a time."""
    held, size = [], 0
    for doc, frame in enumerate(frames):
        for at in range(0, len(frame), CHUNK):
            start = max(0, at - order)
            held.append((doc, frame[start : at + CHUNK], at - start))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield coded(held, order)
                held, size = [], 0
    if held:
        yield coded(held, order)


def pair_counts(rows: DataFrame, order: int) -> DataFrame:
    """rows(text, held_out) to (key, c, seen): a pair's occurrences in training documents and in all."""

    def out(distinct, n):
        for i in range(0, len(distinct), LEAVE):
            yield pa.RecordBatch.from_arrays([pa.array(distinct[i : i + LEAVE].view(np.int64)), pa.array(n[i : i + LEAVE])], ["key", "n"])

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for part in slices(batch):
                held = np.array(part.column("held_out").to_pylist(), np.uint64) << np.uint64(HELD)
                for doc, key in symbols(map(framed, texts(part.column("text"))), order):
                    waiting.append(key | held[doc])
                    del doc, key
                    size += len(waiting[-1])
                    if size < KEPT // 2:
                        continue
                    keys, counts = added(keys, counts, waiting)
                    size = 0
                    if len(keys) > KEPT:  # the rarer half leaves: what is frequent would leave again and again
                        often = counts > np.partition(counts, len(counts) // 2)[len(counts) // 2]
                        yield from out(keys[~often], counts[~often])
                        keys, counts = keys[often], counts[often]
        if waiting:
            keys, counts = added(keys, counts, waiting)
        yield from out(keys, counts)

    raw = rows.select("text", "held_out").mapInArrow(run, "key long, n long")
    one = raw.select(F.expr(f"key & {(1 << HELD) - 1}L").alias("key"), F.expr(f"if(key >= {1 << HELD}L, 0L, n)").alias("c"), F.col("n").alias("seen"))
    return one.groupBy("key").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def low_trie(pairs: DataFrame, order: int) -> Trie:
    """The trie of the orders up to `order`, from the counted pairs."""
    depth = F.least(F.shiftright("key", DEPTH), F.lit(order)).cast("long")
    node = F.shiftleft(depth, DEPTH).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)))
    found = pairs.where("c > 0").groupBy(node.alias("key")).agg(F.sum("c").alias("n")).toArrow()
    return Trie(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy(), order)


def priced_pairs(pairs: DataFrame, order: int) -> DataFrame:
    """pairs with cost, the log10 probability of the symbol in its context."""
    spark = pairs.sparkSession.sparkContext
    low = spark.broadcast(low_trie(pairs, min(LOW - 1, order)))

    def price(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys, c = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy()
        cost = Trie(keys[c > 0], c[c > 0], order, low.value).cost((keys >> np.uint64(DEPTH)).astype(np.int64), keys & np.uint64(PAIR))
        yield from pa.table({"key": table["key"], "seen": table["seen"], "cost": pa.array(cost)}).to_batches(1 << 16)

    n = max(spark.defaultParallelism, pairs.count() // PART + 1)
    suffix = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))
    return pairs.repartition(n, suffix).mapInArrow(price, "key long, seen long, cost double")


def frequent(counted: DataFrame, most: int, *columns: str):
    """At most `most` rows with the greatest `seen`, all of whose eighth part of an octave are among them, as an Arrow table."""
    size = F.floor(F.log2("seen") * 8)
    least, n = 1 << 20, 0
    for s, k in sorted(map(tuple, counted.groupBy(size).count().collect()), reverse=True):
        n += k
        if n > most:
            break
        least = s
    return counted.where(size >= least).select(*columns).toArrow()


class Costs:
    """Costs by pair, in an open hash table that each worker lays out once."""

    FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.keys, self.costs, self.table = keys, costs, None

    def __getstate__(self):
        return {"keys": self.keys, "costs": self.costs, "table": None}

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def laid_out(self) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.bits = max(4, (2 * len(self.keys)).bit_length())
            slot, cost = np.full(1 << self.bits, self.FREE), np.zeros(1 << self.bits)
            todo, at = np.arange(len(self.keys)), self.place(self.keys)
            while len(todo):
                free = slot[at] == self.FREE
                slot[at[free]] = self.keys[todo[free]]
                own = slot[at] == self.keys[todo]
                cost[at[own]] = self.costs[todo[own]]
                todo, at = todo[~own], (at[~own] + 1) & ((1 << self.bits) - 1)
            self.table, self.keys, self.costs = (slot, cost), None, None
        return self.table

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is here, and its cost or else 0."""
        slot, cost = self.laid_out()
        at = self.place(wanted)
        there = slot[at]
        hit = there == wanted
        out = np.where(hit, cost[at], 0.0)
        todo = np.nonzero(~hit & (there != self.FREE))[0]
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(slot) - 1)
            there = slot[at]
            own = there == wanted[todo]
            hit[todo[own]], out[todo[own]] = True, cost[at[own]]
            more = ~own & (there != self.FREE)
            todo, at = todo[more], at[more]
        return hit, out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, order: int = ORDER, hot: int = HOT, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Training documents: those whose crc32 of the id as text has another remainder than held_fold by folds.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.crc32(name) % folds == held_fold).alias("held_out"))
    counted = durable(word_counts(rows.select("text", "held_out")), "words")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    based = counted.select("word", (F.col("c") > 0).alias("known"), "seen", F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("base"))
    top = frequent(based.where(F.octet_length("word") <= LONGEST_HOT), hot, "word", "known", "base")
    words = spark.sparkContext.broadcast((top["word"].combine_chunks().cast(pa.binary()), np.append(top["known"].to_numpy(), False).astype(np.int64), np.append(top["base"].to_numpy(), 0.0)))
    pairs = durable(pair_counts(rows, order), "pairs")
    priced = durable(priced_pairs(pairs, order), "priced")
    forget(pairs)
    top = frequent(priced, hot_pairs, "key", "cost")
    common = spark.sparkContext.broadcast(Costs(top["key"].to_numpy().view(np.uint64), top["cost"].to_numpy()))

    def add_up(batch: pa.RecordBatch):
        (top_words, top_known, top_base), costs = words.value, common.value
        for part, word, row, at in listed_words(batch, top_words):
            n = len(part)
            add = lambda row, x: np.bincount(row, weights=x, minlength=n)
            cost, rare_keys, rare_n = np.zeros(n), [], np.zeros(n, np.int64)
            for doc, key in symbols(map(framed, texts(part.column("text"))), order):
                hit, own = costs.find(key)
                cost += add(doc, own)
                rare_keys.append(key[~hit])
                rare_n += np.bincount(doc[~hit], minlength=n)
            rare = at.is_null().to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, len(top_base) - 1).to_numpy()
            listed = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("held_out"), pa.array(np.bincount(row, minlength=n)), pa.array(add(row, top_known[at]).astype(np.int64)), pa.array(add(row, top_base[at])), pa.array(cost),
                    listed(np.bincount(row[rare], minlength=n), word.filter(pa.array(rare))), listed(rare_n, pa.array(np.concatenate(rare_keys).view(np.int64))),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "cost", "rare", "pairs"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, cost double, rare array<binary>, pairs array<long>"
    summed = durable(map_batches(rows, add_up, schema).withColumn("uid", F.monotonically_increasing_id()), "sums")
    rare = summed.select("uid", F.explode("rare").alias("word"))
    found = rare.join(based.select("word", "known", "base"), "word")
    more = found.groupBy("uid").agg(F.count_if("known").alias("more_known"), F.sum("base").alias("more_base"))
    costs = summed.select("uid", F.explode("pairs").alias("key")).join(priced.select("key", F.col("cost").alias("p")), "key").groupBy("uid").agg(F.sum("p").alias("more_cost"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return summed.drop("rare", "pairs").join(more, "uid", "left").join(costs, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("cost", "more_cost").alias("score"),
    )
