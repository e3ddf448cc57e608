"""Nested documents, attachments and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import prefix


def map_values(entries: DataFrame, keys: list[str], tag: Column, value: str) -> DataFrame:
    """Visible scalars of map entries: the greatest tag wins, a null value removes the key."""
    return entries.groupBy(*keys).agg(F.max_by(value, tag).alias(value)).where(F.col(value).isNotNull())


def owners(children: DataFrame) -> DataFrame:
    """Child objects that more than one place owns: a document with any is invalid."""
    return children.groupBy("child").agg(F.count_distinct("owner").alias("owners")).where("owners > 1")


def verified(objects: DataFrame, content: Column, size: Column, sha256: Column) -> DataFrame:
    """objects with size_ok and digest_ok: whether the bytes are as long as, and have the digest that, the reference says."""
    return objects.withColumns({"size_ok": F.octet_length(content) == size, "digest_ok": F.sha2(content.cast("binary"), 256) == sha256})


def nearest_rank(rows: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles and the greatest value of each key. Equal values are counted before they are ranked."""
    counts = rows.groupBy(key, value).agg(F.count(value).alias("__c"), F.count("*").alias("__r"))
    ranked = prefix(counts, [key], value, {"__upto": F.col("__c")})
    size = counts.groupBy(F.col(key).alias("__key")).agg(F.sum("__c").alias("__n"), F.sum("__r").alias("n"))
    placed = ranked.join(size, F.col(key).eqNullSafe(F.col("__key")))
    cuts = [F.min(F.when(F.col("__upto") >= F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(p))), F.col(value))).alias(name) for name, p in points.items()]
    return placed.groupBy(key).agg(F.first("n").alias("n"), *cuts, F.max(value).alias("most"))


def regressions(rows: DataFrame, key: str, value: str, is_base: Column, least: int, percent: int) -> DataFrame:
    """Keys with `least` samples on both sides: medians of base and candidate, and whether the latter is `percent` greater."""
    middle = lambda when: F.percentile(F.when(when, F.col(value)), F.lit(0.5))
    found = rows.groupBy(key).agg(F.count_if(is_base).alias("n_base"), F.count_if(~is_base).alias("n_candidate"), middle(is_base).alias("base"), middle(~is_base).alias("candidate"))
    return found.where((F.col("n_base") >= least) & (F.col("n_candidate") >= least)).withColumn("regressed", F.col("candidate") * 100 > F.col("base") * (100 + percent))
