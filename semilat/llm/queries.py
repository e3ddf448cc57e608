"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, found

    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("strict", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found(read(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(listed("strict"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, page_languages

    return page_languages(read(spark, sf_dir, "pages"), fit(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "page_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    found = simhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extracted

    return extracted(read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    found = round_trip(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cap_filters import near_vectors

    found = near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.equal_null("id", "component").alias("kept"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import scores

    return scores(read(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import edit_report

    return edit_report(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken, word_count

    sized = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return taken(sized, "size").select("doc_id", "size", F.col("__mix_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages),
m as (select d, max(page_id) last from p group by d)
select page_id, octet_length(encode(h))::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.d, (i // 8 * 10 + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id is distinct from last then 'revisit' else 'response' end record_type,
  case when page_id is distinct from last then last end refers_to
from p join m on p.d = m.d
"""

OP6_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5(coalesce(doc_id::varchar, '')) k
  from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) n from d group by source),
w as (select source, source_size, [3, 1, 2][((n - 1) % 3 + 1)::int]::bigint weight from s),
r as (select *, source_size * 2 lim, (source_size * 2)::double / weight ratio from w),
l as (
  select *, ((sum(source_size) over ())::double * 1.5 - coalesce((sum(lim) over f)::double, 0)) / ((sum(weight) over ()) - coalesce(sum(weight) over f, 0))::double lvl,
    row_number() over (order by ratio, source nulls last) nth
  from r window f as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
a as (select first(lvl order by nth) filter (ratio > lvl) at_level from l),
t as (select source, source_size, case when at_level is null or ratio <= at_level then lim::double else weight * at_level end target from l, a),
b as (
  select d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint bef
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::bigint - bef)) + greatest(0, least(size, floor(target)::bigint - source_size - bef)))::bigint taken
from b
"""

QUERIES = {
    "op1_html": op1_html,
    "op2_warc": op2_warc,
    "op3_cap_filters": op3_cap_filters,
    "op4_ppm": op4_ppm,
    "op5_winnowing": op5_winnowing,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_langid": op9_langid,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op6_mixing": OP6_SQL}
