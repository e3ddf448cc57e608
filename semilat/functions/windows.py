"""Running totals and places within few, large keys: no task holds a whole key.

A key's rows are cut into blocks of the ordering number. Each block is summed first; the sums are accumulated by key (one
row a block), and each block is then accumulated by itself from where the blocks before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block in units of the ordering number.
BLOCK = 1 << 16


def prefix(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, ties: tuple[str, ...] = (), width: int = BLOCK) -> DataFrame:
    """rows with running sums and running maxima by keys, in order of a number and then of the ties, own row included."""
    sums, tops = sums or {}, tops or {}
    made = rows.withColumns({f"__v_{n}": c for n, c in (sums | tops).items()}).withColumn("__block", F.floor(F.col(order) / width))
    totals = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums] + [F.max(f"__v_{n}").alias(f"__t_{n}") for n in tops]
    names = {k: f"__k{i}" for i, k in enumerate([*keys, "__block"])}
    blocks = made.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*totals)
    before = Window.partitionBy(*[names[k] for k in keys]).orderBy(names["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.sum(f"__t_{n}").over(before).alias(f"__a_{n}") for n in sums] + [F.max(f"__t_{n}").over(before).alias(f"__a_{n}") for n in tops]
    starts = blocks.select(*names.values(), *ahead)
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    within = Window.partitionBy(*keys, "__block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(F.col(f"__a_{n}"), F.lit(0)) + F.sum(f"__v_{n}").over(within) for n in sums}
    out |= {n: F.greatest(F.col(f"__a_{n}"), F.max(f"__v_{n}").over(within)) for n in tops}
    return made.join(starts, match).select(*rows.columns, *[c.alias(n) for n, c in out.items()])


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their place by keys, from 1."""
    return prefix(rows, keys, order, {name: F.lit(1).cast("long")}, ties=ties)
