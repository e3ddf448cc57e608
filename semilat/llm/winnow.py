"""Winnowing fingerprints of documents, with DataFrame functions only.

A text's words are hashed, each run of GRAM words gives a hash, and of each WINDOW consecutive run hashes the smallest is
chosen, the rightmost of equal ones. The chosen hashes with their positions are the fingerprint: any passage of
GRAM + WINDOW - 1 words that two texts share is represented in both. A text with fewer words than GRAM gives one hash of
all its words, one without words an empty fingerprint.

Window minima come from halves: the place of the minimum of 2w hashes is the better of the places of two times w, so
WINDOW, a power of two, takes its logarithm of passes over an array.

`with_next` gives each row that follows it in descending id (the last: the first) without sorting all rows in one task.
Ids are cut into ranges at approximate quantiles, a range is one window partition, and the top row of each range is also
sent, as a row that only lends its text, to the range above. The table of ranges is bounded by RANGES, whatever the
size of the input.

Nulls: a null text is an empty one; null ids come last in the order. Equal ids follow each other by descending text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

GRAM, WINDOW = 5, 16
CUTS, RANGES, RANGE_ROWS = 256, 16384, 500
LEAST = -(2**63)


def gram_hashes(text: Column, gram: int = GRAM) -> tuple[Column, Column]:
    """Hashes of a text's words, and of the runs of `gram` of them, once the former are column __w."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), F.size("__w") - gram), lambda i: F.xxhash64(*[F.get(F.col("__w"), i + d) for d in range(gram)]))
    short = F.when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>"))
    return words, F.when(F.size("__w") >= gram, runs).otherwise(short)


def winnowed(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df with `out`, an array of the chosen places, and `out`_h, the hashes at them."""
    words, hashes = gram_hashes(F.col(text_col), gram)
    df = df.withColumn("__w", words).withColumn("__h", hashes).drop("__w")
    df = df.withColumn("__p", F.when(F.size("__h") > 0, F.sequence(F.lit(0), F.size("__h") - 1)).otherwise(F.array().cast("array<int>")))

    def halves(step: int):
        def better(a: Column, i: Column) -> Column:
            b = F.get(F.col("__p"), i + step)
            return F.when(b.isNull() | (F.get(F.col("__h"), a) < F.get(F.col("__h"), b)), a).otherwise(b)

        return better

    step = 1
    while step < window:
        df = df.withColumn("__q", F.transform("__p", halves(step))).drop("__p").withColumnRenamed("__q", "__p")
        step *= 2
    full = F.slice("__p", 1, F.greatest(F.lit(1), F.size("__h") - (window - 1)))
    df = df.withColumn(out, F.array_distinct(full)).drop("__p")
    return df.withColumn(f"{out}_h", F.transform(out, lambda p: F.get(F.col("__h"), p))).drop("__h")


def rendered(places: str, hashes: str) -> Column:
    """The fingerprint as text: hash in hexadecimal and word position, in order of position."""
    return F.array_join(F.zip_with(hashes, places, lambda h, p: F.concat(F.hex(h), F.lit("@"), p.cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ranges(df: DataFrame, key: str) -> tuple[Column, int]:
    """A column of range numbers that does not fall as key rises, and their count."""
    share = ", ".join(f"{i / CUTS}d" for i in range(CUTS + 1))
    found = df.agg(F.count("*").alias("n"), F.expr(f"percentile_approx({key}, array({share}), 10000)").alias("q")).first()
    cuts = sorted({*(found["q"] or ()), LEAST})
    per = max(1, min(RANGES // len(cuts), -(-found["n"] // (RANGE_ROWS * len(cuts)))))
    table = F.array(*[F.lit(c) for c in cuts])
    at = F.size(F.filter(table, lambda c: c <= F.col(key)))
    low, high = F.get(table, at - 1).cast("double"), F.get(table, at).cast("double")
    within = F.least(F.lit(per - 1), F.floor((F.col(key).cast("double") - low) / (high - low) * per))
    return (at * per + F.coalesce(within, F.lit(0))).cast("int"), (len(cuts) + 1) * per


def with_next(df: DataFrame, id_col: str, text_col: str, use) -> DataFrame:
    """use(rows, window): rows has df's columns, __lends and the row order in the window; rows that only lend are dropped after."""
    keyed = df.withColumn("__key", F.coalesce(F.col(id_col), F.lit(LEAST)))
    number, _ = ranges(keyed, "__key")
    tops = keyed.select("__key", number.alias("__range")).groupBy("__range").agg(F.max("__key").alias("__top"))
    above = F.lead("__range").over(Window.orderBy("__range"))
    tops = tops.withColumn("__above", F.coalesce(above, F.min("__range").over(Window.partitionBy())))
    keyed = keyed.withColumn("__range", number).join(F.broadcast(tops), "__range")
    targets = F.when(F.col("__key") == F.col("__top"), F.array(F.struct(F.col("__range").alias("at"), F.lit(False).alias("lends")), F.struct(F.col("__above").alias("at"), F.lit(True).alias("lends"))))
    targets = F.coalesce(targets, F.array(F.struct(F.col("__range").alias("at"), F.lit(False).alias("lends"))))
    sent = keyed.withColumn("__to", F.explode(targets)).select(*df.columns, "__key", F.col("__to.at").alias("__at"), F.col("__to.lends").alias("__lends"))
    window = Window.partitionBy("__at").orderBy("__lends", F.col("__key").desc(), F.col(text_col).desc())
    return use(sent, window)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to it and to the next document's."""

    def use(rows: DataFrame, order) -> DataFrame:
        rows = rows.withColumn("__next", F.lead("__text").over(order))
        half = F.floor(F.col("n_chars") / 2).cast("int")
        edited = F.concat(F.substring("__text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), half))
        rows = rows.withColumn("n_chars", F.char_length("__text").cast("long")).withColumn("__edited", edited)
        rows = winnowed(rows, "__text", "__a", gram, window)
        rows = rows.withColumn("__after", F.lead("__a_h").over(order))
        rows = winnowed(rows.where("not __lends"), "__edited", "__b", gram, window)
        return rows.select(
            F.col("__id").alias("doc_id"), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), rendered("__a", "__a_h").alias("fingerprint"), rendered("__b", "__b_h").alias("edited_fingerprint"),
            likeness("__a_h", "__b_h").alias("near_edited"), likeness("__a_h", "__after").alias("near_next"),
        )

    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return with_next(chosen, "__id", "__text", use)
