"""Zstandard WARC archives: a writer with payload deduplication and a validating reader.

An archive is a skippable frame that holds a dictionary (magic 0x184D2A5D, little-endian length, the dictionary), and
then one Zstandard frame a record. The reader takes the dictionary from that leading frame, decodes frame by frame, and
checks each record: version line, mandatory headers, block length, frame content holding exactly one record, payload
length against the HTTP header, and the payload's digest.

A payload that another row has too is stored once: the row with the largest id of those with equal payloads of at least
`least` bytes is the response, the others are revisit records that name it. Which those are is settled on ids and
digests alone; the bodies are shuffled once, by id.

Archives are written by the tasks through the file system that the folder's address names (file, hdfs, s3, gcs), under a
temporary name and then renamed, so that a repeated task replaces its file with the same bytes. They are read back by
Spark. An archive is closed at `archive_bytes`, so that one fits in a task.

The reader takes records of any WARC type and of other writers: header names in any case, folded lines, records without
an HTTP header, revisits without a reference, further skippable frames.

Nulls: a null html is an empty payload; a null id is written without one and read back as null. It is below all others, so
that such a row revisits a row with an id and the same payload; without one, it is a response. Rows that repeat the
largest id of their payload are responses of their own. Repeated other rows are revisits each.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, durable, map_batches, new_path

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

ARCHIVE_BYTES = 16 << 20
DICTIONARY_ROWS, DICTIONARY_BYTES = 500, 64 << 10
#: Archives carry no clock, so that a repeated task writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 3
SCHEMA = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


class Invalid(ValueError):
    """An archive or record that is not as it should be."""


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, number: int) -> bytes:
    """One WARC record; a revisit has refers_to and no payload, but the HTTP header of the whole one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    name = f"row:{page_id}" if page_id is not None else f"none:{number}"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:row:{refers_to}>")]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def start(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frames(archive: bytes) -> tuple[zstandard.ZstdCompressionDict | None, Iterator[bytes]]:
    """The dictionary of the leading skippable frame, if there is one, and the content of each further frame."""
    at, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        if 8 + size > len(archive):
            raise Invalid("the dictionary frame is cut off")
        content = archive[8 : 8 + size]
        if content[:4] == struct.pack("<I", FRAME):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
        at = 8 + size

    def each(at: int) -> Iterator[bytes]:
        view = memoryview(archive)
        tool = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while at < len(view):
            end, holds = frame_end(view, at)
            if holds:
                one = tool.decompressobj()
                try:
                    content = one.decompress(view[at:end])
                except zstandard.ZstdError as e:
                    raise Invalid(f"a frame can't be decoded: {e}") from e
                if not one.eof:
                    raise Invalid("a frame is cut off")
                yield content
            at = end

    return dictionary, each(at)


def frame_end(view: memoryview, at: int) -> tuple[int, bool]:
    """Where the frame at this place ends, from the lengths in its headers, and whether it holds data (or is skippable)."""
    try:
        magic = struct.unpack_from("<I", view, at)[0]
        if magic >> 4 == SKIPPABLE >> 4:
            end, holds = at + 8 + struct.unpack_from("<I", view, at + 4)[0], False
        elif magic == FRAME:
            flags = view[at + 4]
            single = flags >> 5 & 1
            end, last, holds = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6], 0, True
            while not last:
                block = int.from_bytes(view[end : end + 3], "little")
                last = block & 1
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
                if end > len(view):
                    break
            end += 4 * (flags >> 2 & 1)
        else:
            raise Invalid("no frame where one is due")
    except (struct.error, IndexError) as e:
        raise Invalid("the last frame is cut off") from e
    if end > len(view):
        raise Invalid("the last frame is cut off")
    return end, holds


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by names in lower case, and its block, checked."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise Invalid("a record doesn't start with its version and headers")
    headers, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the one before
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Invalid("a header line has no colon")
        name = name.strip().lower()
        headers.setdefault(name, value.strip())
    if missing := [h for h in MANDATORY if h.lower() not in headers]:
        raise Invalid(f"missing headers: {missing}")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()) or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Invalid("a record's length isn't its Content-Length")
    return headers, rest[:-4]


def row_of(name: str | None) -> int | None:
    """The row that a record id of this module's writer names; null for others."""
    m = re.fullmatch(r"<?urn:row:(-?[0-9]+)>?", name or "")
    return int(m[1]) if m else None


def checked(content: bytes) -> tuple:
    """(id, url, payload, payload length, digest, type, refers to, record id, id referred to) of any record.

    The payload is the block, without the header of an HTTP response. A length or digest that the headers give must be
    the payload's. Lengths and digests that they don't give are those of the payload, or null for a revisit.
    """
    headers, block = parse(content)
    kind, algorithm, digest = headers["warc-type"].lower(), *headers.get("warc-payload-digest", ":").partition(":")[::2]
    payload, length = block, None
    if kind in ("response", "revisit") and headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if block and not (mark and http.startswith(b"HTTP/")):
            raise Invalid("no HTTP header where one is due")
        fields = [line.partition(b":") for line in http.split(b"\r\n")]
        given = next((value.strip() for name, _, value in fields if name.strip().lower() == b"content-length"), None)
        coded = any(name.strip().lower() == b"transfer-encoding" for name, _, _ in fields)
        if given is not None and not coded:
            if not given.isdigit():
                raise Invalid("an HTTP length that is no number")
            length = int(given)
    if kind == "revisit":
        if payload:
            raise Invalid("a revisit has a payload")
    else:
        if length is not None and len(payload) != length:
            raise Invalid("a payload isn't as long as its header says")
        length = len(payload)
        if kind in ("response", "resource") and algorithm.lower() == "sha1" and digest.upper() != base32_sha1(payload):
            raise Invalid("a payload has another digest")
        digest = digest or base32_sha1(payload)
    name, refers = headers["warc-record-id"], headers.get("warc-refers-to")
    return row_of(name), headers.get("warc-target-uri", ""), payload, length, digest or None, kind, row_of(refers), name, refers


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the id of the response that a revisit repeats. A null id is below all."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    keys = durable(rows.where(F.octet_length("payload") >= least).select("id", F.sha1("payload").alias("digest")), "digests")
    most = durable(keys.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "last"), "digests")
    below = (keys.digest == most.of) & (keys.id.isNull() | (keys.id < most["last"])) & most["last"].isNotNull()
    again = keys.join(most, below).groupBy(F.col("id").alias("other"), F.col("digest").alias("other_digest")).agg(F.max("last").alias("refers_to"))
    return rows.join(again, rows.id.eqNullSafe(again.other) & (F.sha1("payload") == again.other_digest), "left").select("id", "url", "payload", "refers_to")


def trained_dictionary(rows: DataFrame, count: int = DICTIONARY_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from about `count` payloads of at most 64 KiB, chosen by hash; empty if they are too few."""
    sample = drawn(rows.where("octet_length(payload) between 8 and 65536").select("id", "payload"), count)
    samples = sorted(bytes(r["payload"]) for r in sample.collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write marked rows as archives in folder; (file, records, bytes) of each, by a plan that writes when it runs."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        held, size, count, archive, number = [start(dictionary)], 0, 0, 0, 0

        def close():
            name = f"part-{part:06d}-{archive:05d}.warc.zst"
            temporary = posixpath.join(base, f"_{name}.{attempt}")
            with store.open_output_stream(temporary) as out:
                for x in held:
                    out.write(x)
            store.move(temporary, posixpath.join(base, name))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([sum(map(len, held))], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                payload = payload.as_py()
                frame = tool.compress(record(page.as_py(), url.as_py(), payload, len(payload), base32_sha1(payload), refers.as_py(), number))
                held.append(frame)
                size, count, number = size + len(frame), count + 1, number + 1
                if size >= archive_bytes:
                    yield close()
                    held, size, count, archive = [start(dictionary)], 0, 0, archive + 1
        if count:
            yield close()

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "file string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in folder, of any type: id and refers_to (rows of this module's writer), url, payload (if
    asked for), payload_bytes, payload_digest, record_type, record_id and refers_to_id."""
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id"]

    def run(batch: pa.RecordBatch):
        for archive in batch.column(0):
            held, size = [], 0
            for content in frames(archive.as_py())[1]:
                row = checked(content)
                held.append(row if payloads else (*row[:2], None, *row[3:]))
                size += len(content) if payloads else 200
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return map_batches(archives, run, SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = False) -> DataFrame:
    """Write pages as archives in the shared folder and read them back, all records checked against the writers' counts."""
    spark = pages.sparkSession
    rows = marked(pages, id_col, url_col, html_col, least)
    folder = new_path(spark, "warc")
    plain = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    written = durable(write_archives(rows, folder, trained_dictionary(plain), archive_bytes), "manifest").agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], SCHEMA)
    return read_archives(spark, folder, payloads)
