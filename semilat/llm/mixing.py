"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

The documents of each source stand in a shuffled order (by the MD5 of their id). A document's virtual finish time is
the number of its source's words up to and with it, divided by the source's target: each source reaches its target at
time 1, which is when the total budget is spent. Documents of all sources are served in that order: a global range sort,
cut where the total reaches the budget, when each source's document in service is taken in part (or not at all, if whole
documents are asked for).
A source may be served up to `cap` times over, each pass in the same order.

Targets: sources, ordered by code point with null last, weigh `weights` in turn and share `budget` times all words.
A target stops at `cap` times its source's size and the excess goes to the others by weight, until none is above. This
is the level at which all sources fill to their caps, found by one window over the sources ordered by cap over weight.

Running totals need no task that holds a whole source: words are summed by source and 1/4096 of the shuffle order,
the sums are accumulated (at most 4096 rows a source), and each such part is accumulated by itself.

Nulls: a null text has no words; a null source is a source of its own; a null id is shuffled as an empty one. Repeated
rows are rows of their own; ties in the order (equal ids) go by size. Without any word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

WEIGHTS = (3, 1, 2)
#: Ranges of finish time into which the mix is sorted.
RANGES = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """sources(source, source_size) with target, a double. One row a source: small however many documents there are."""
    order, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long").alias("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("limit").over(fill), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("nth", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    )
    above = F.col("ratio") > F.col("level")
    level = F.min_by(F.when(above, F.col("level")), F.when(above, F.col("nth"))).over(every)
    full = F.col("limit").cast("double")
    return ranked.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull() | (F.col("ratio") <= F.col("at")), full).otherwise(F.col("weight") * F.col("at")).alias("target"))


def source_key(source_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))


def goals_of(docs: DataFrame, size_col: str, source_col: str, weights, budget: float, cap: int) -> DataFrame:
    """(__mix_source, __mix_size, __mix_target, __mix_budget) of each source; the last is the sum of the targets."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    goals = targets(sizes, weights, budget, cap).withColumn("total", F.sum("target").over(Window.partitionBy()))
    return durable(goals.select(source_key("source").alias("__mix_source"), F.col("source_size").alias("__mix_size"), F.col("target").alias("__mix_target"), F.col("total").alias("__mix_budget")), "mix")


def schedule(docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """docs with __mix_size and __mix_target (the source's), __mix_budget and __mix_before, the source's words ahead of the row."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    shaped = docs.withColumns({"__mix_source": source_key(source_col), "__mix_key": key, "__mix_part": F.substring(key, 1, 3)})
    parts = durable(shaped.groupBy("__mix_source", "__mix_part").agg(F.first(source_col).alias("source"), F.sum(size_col).alias("words")), "mix")
    goals = goals_of(parts, "words", "source", weights, budget, cap)
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("__mix_source").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = durable(parts.join(goals, "__mix_source").withColumn("__mix_ahead", ahead).drop("source", "words"), "mix")
    own = Window.partitionBy("__mix_source", "__mix_part").orderBy("__mix_key", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = shaped.join(starts, ["__mix_source", "__mix_part"])
    return placed.withColumn("__mix_before", F.col("__mix_ahead") + F.coalesce(F.sum(size_col).over(own), F.lit(0))).drop("__mix_source", "__mix_part", "__mix_key", "__mix_ahead")


def served(docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix in order of virtual finish time, a row for each pass in which a document is served any words.

    docs with __mix_size and __mix_target (its source's), __mix_turn, __mix_finish, __mix_taken (words served; the
    document in service of each source when the budget is spent is served in part), and __mix_total, the words of the mix
    up to and with the row. Rows are sorted by ranges of finish time, whose sums give each range its start, and cut where
    the total reaches the sum of the targets.
    """
    rows = schedule(docs, size_col, id_col, source_col, weights, budget, cap).withColumn("__mix_turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    rows = rows.withColumn("__mix_start", F.col("__mix_turn") * F.col("__mix_size") + F.col("__mix_before"))
    rows = rows.withColumn("__mix_words", F.least(F.col(size_col), F.floor("__mix_target") - F.col("__mix_start"))).where("__mix_words > 0")
    rows = rows.withColumn("__mix_finish", F.least(F.lit(1.0), (F.col("__mix_start") + F.col(size_col)) / F.col("__mix_target")))
    rows = durable(rows.withColumn("__mix_range", F.floor(F.col("__mix_finish") * RANGES).cast("int")), "mix")
    sums = rows.groupBy(F.col("__mix_range").alias("__mix_at")).agg(F.sum("__mix_words").alias("words"))
    before = Window.orderBy("__mix_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__mix_at", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__mix_ahead"))  # RANGES + 1 rows at most
    own = Window.partitionBy("__mix_range").orderBy("__mix_finish", F.col(source_col).asc_nulls_last(), id_col, "__mix_turn").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = rows.join(F.broadcast(starts), F.col("__mix_range") == F.col("__mix_at")).withColumn("__mix_total", F.col("__mix_ahead") + F.sum("__mix_words").over(own))
    left = F.floor("__mix_budget") - (F.col("__mix_total") - F.col("__mix_words"))
    cut = sorted_.withColumn("__mix_taken", F.least("__mix_words", left)).where("__mix_taken > 0")
    return cut.drop("__mix_before", "__mix_start", "__mix_words", "__mix_range", "__mix_at", "__mix_ahead", "__mix_budget")


def taken(docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """docs with __mix_size, __mix_target and __mix_taken, the words that the mix takes of each row over all passes."""
    rows = durable(docs.withColumn("__mix_uid", F.monotonically_increasing_id()), "mix")
    mix = served(rows.select("__mix_uid", id_col, source_col, size_col), size_col, id_col, source_col, weights, budget, cap)
    sums = mix.groupBy(F.col("__mix_uid").alias("__mix_of")).agg(F.sum("__mix_taken").alias("__mix_taken"))
    goals = goals_of(rows, size_col, source_col, weights, budget, cap).drop("__mix_budget").withColumnRenamed("__mix_source", "__mix_its")
    placed = rows.withColumn("__mix_source", source_key(source_col)).join(goals, F.col("__mix_source") == F.col("__mix_its"))
    joined = placed.join(sums, F.col("__mix_uid") == F.col("__mix_of"), "left").withColumn("__mix_taken", F.coalesce("__mix_taken", F.lit(0)))
    return joined.drop("__mix_uid", "__mix_of", "__mix_source", "__mix_its")


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """docs as the mix serves them: whole documents, up to `cap` times each, in files sorted by virtual finish time."""
    columns = docs.columns
    sized = docs.withColumn("__mix_words", word_count(F.col(text_col)))
    passes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda turn: turn * F.col("__mix_size") + F.col("__mix_before") + F.col("__mix_words")))
    served = schedule(sized, "__mix_words", id_col, source_col, weights, budget, cap).withColumn("__mix_served", passes)
    kept = served.where("__mix_served <= __mix_target").withColumn("__mix_finish", F.expr("coalesce(try_divide(__mix_served, __mix_target), 0d)"))
    return kept.repartitionByRange("__mix_finish").sortWithinPartitions("__mix_finish", id_col).select(*columns)
