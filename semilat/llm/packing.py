"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

A document's ids (a closing id included) stay whole if they fit; a longer document is cut into pieces of the capacity,
of which the first takes what is left over. A full piece is a sequence by itself. The others are dealt by hash into
groups of about GROUP pieces, each packed by itself: pieces in descending length go to the open bin with the least
sufficient room, which a segment tree over the remaining capacities finds in logarithmic time. A group leaves about one
bin that a single packing of all pieces might have saved.

The ids are those of the public byte-level BPE. In that vocabulary's pattern a lone space always opens a new part, so a
text of common letters without double spaces is split there, and each distinct part is encoded once per task by the
ranks file of the same vocabulary; any other text, and one that holds the text of an added token, goes whole through the JSON tokenizer. Only lengths and checksums leave the tasks.

A null text is an empty one: one piece with the closing id only. Null ids and repeated rows are packed like others.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches

CAPACITY = 1024
END_ID = 2
GROUP = 4096
#: Distinct parts of texts that a task keeps encoded; at this many it starts anew.
KEPT = 600_000
#: Characters on which Unicode versions cannot differ as to letters, digits and white space.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")


class Encoder(dict):
    """Encodes texts as little-endian unsigned 32-bit ids; itself maps parts of texts to their ids after a space."""

    def __init__(self, ranks: str, whole: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.path, self.tokenizer = whole, None
        with open(whole, encoding="utf-8") as f:
            self.named = tuple(t["content"] for t in json.load(f)["added_tokens"])

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[part] = ids = array("I", self.one(" " + part)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if "  " not in text and COMMON.fullmatch(text) and not any(t in text for t in self.named):
            first, *rest = text.split(" ")
            return array("I", self.one(first)).tobytes() + b"".join(map(self.__getitem__, rest))
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; equal lengths keep their order."""
    size = 1 << capacity.bit_length()
    tree, open_bins, out, bins = [0] * (2 * size), [[] for _ in range(capacity + 1)], [(0, 0)] * len(lengths), 0

    def add(room: int, by: int) -> None:
        i = room + size
        while i:
            tree[i] += by
            i >>= 1

    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        i = lengths[k] + size
        while i and not tree[i]:
            while i & 1:  # a right child: what lies to its right is its ancestors'
                i >>= 1
            i = i + 1 if i else 0
        if i:
            while i < size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            room = i - size
            chosen = open_bins[room].pop()
            add(room, -1)
        else:
            room, chosen, bins = capacity, bins, bins + 1
        out[k] = (chosen, capacity - room)
        if rest := room - lengths[k]:
            open_bins[rest].append(chosen)
            add(rest, 1)
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, in the documents' order."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(paths).encode, []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + end
            rows += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_batches(chosen, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None, group: int = GROUP) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = durable(pieces(docs, id_col, text_col, capacity, end_id, paths or default_paths()).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        places = best_fit_decreasing(rows["length"].tolist(), capacity)
        bins = np.array([b for b, _ in places], np.int64)
        head = rows["uid"].groupby(bins).min()
        return rows.assign(sequence_id=head.reindex(bins).to_numpy() * 2, offset=np.array([o for _, o in places], np.int64)).drop(columns="grp")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long"
    dealt = short.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, schema).unionByName(full).drop("uid")
