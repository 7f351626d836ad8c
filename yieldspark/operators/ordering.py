"""Global positions and running sums without a single-task window.

Rows are dealt into ordered ranges; each range counts or sums on its own, and the ranges' totals (a row a
range) are added up before they are joined back. The dealt table is staged, so both readings agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from yieldspark.sources.staging import stage

RANGE_ROWS = 2_000_000
#: Rows of one key that a window of bounded reach takes at once.
BLOCK_ROWS = 1_000_000


def row_ranges(df: DataFrame) -> int:
    """Ranges that hold about RANGE_ROWS rows each; counted once where several operators take the same rows."""
    return max(1, -(-df.count() // RANGE_ROWS))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], ranges: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with running totals (own row included) in the given order, within keys if any; order keys must not repeat."""
    keys = keys or []
    ranges = ranges or row_ranges(df)
    if ranges == 1:
        whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(n) for n, c in sums.items()))
    dealt = stage(df.repartitionByRange(ranges, *map(F.col, keys), *order).withColumn("range__", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("range__", *keys).agg(*(F.sum(c).alias(f"{n}__") for n, c in sums.items()))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    offsets = totals.select(F.col("range__").alias("of__"), *(F.col(k).alias(f"{k}__key") for k in keys), *(F.coalesce(F.sum(f"{n}__").over(before), F.lit(0)).alias(f"{n}__") for n in sums))
    same = F.col("range__") == F.col("of__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__key"))
    out = dealt.select("*", *(F.sum(c).over(own).alias(n) for n, c in sums.items())).join(offsets if keys else F.broadcast(offsets), same)
    return out.select(*df.columns, *((F.coalesce(F.col(n), F.lit(0)) + F.col(f"{n}__")).alias(n) for n in sums))


def positions(df: DataFrame, order: list[Column], name: str = "pos", ranges: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with the dense 0-based position of each row in a total order, within keys if any."""
    out = running_sums(df, order, {name: F.lit(1).cast("long")}, ranges, keys)
    return out.withColumn(name, F.col(name) - 1)


def look_back(df: DataFrame, keys: list[str], order: list[str], reach: int, made: Callable[[WindowSpec], dict[str, Column]], ranges: int | None = None) -> DataFrame:
    """df with the columns that `made` builds over a window of the rows of a key in order.

    They may look at the row and up to `reach` rows before it. Where df is large, the rows of a key are cut in
    blocks, and each block is led by the last rows of the one before, so no task holds a whole key.
    """
    ranges = ranges or row_ranges(df)
    if ranges == 1:
        return df.withColumns(made(Window.partitionBy(*keys).orderBy(*order)))
    placed = positions(df, [F.col(c) for c in order], "place__", ranges, keys)
    block, left = F.floor(F.col("place__") / BLOCK_ROWS), BLOCK_ROWS - F.col("place__") % BLOCK_ROWS
    cut = placed.withColumn("own__", block).withColumn("block__", F.explode(F.when(left <= reach, F.array("own__", F.col("own__") + 1)).otherwise(F.array("own__"))))
    out = cut.withColumns(names := made(Window.partitionBy(*keys, "block__").orderBy("place__")))
    return out.where("own__ = block__").select(*(c for c in df.columns if c not in names), *names)


def look_around(df: DataFrame, keys: list[str], order: list[str], reach: int, made: Callable[[WindowSpec], dict[str, Column]], ranges: int | None = None) -> DataFrame:
    """As look_back, for columns that look at up to `reach` rows on either side: blocks are led and followed by
    the next rows of their neighbours."""
    ranges = ranges or row_ranges(df)
    if ranges == 1:
        return df.withColumns(made(Window.partitionBy(*keys).orderBy(*order)))
    placed = positions(df, [F.col(c) for c in order], "place__", ranges, keys)
    block, into = F.floor(F.col("place__") / BLOCK_ROWS), F.col("place__") % BLOCK_ROWS
    near = F.array(F.col("own__"), F.when(into < reach, F.col("own__") - 1), F.when(BLOCK_ROWS - into <= reach, F.col("own__") + 1))
    cut = placed.withColumn("own__", block).withColumn("block__", F.explode(F.array_compact(near)))
    out = cut.withColumns(names := made(Window.partitionBy(*keys, "block__").orderBy("place__")))
    return out.where("own__ = block__").select(*(c for c in df.columns if c not in names), *names)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys and a column for each named probability: exact quantiles, linear between ranks, nulls left out.

    weight names a column of whole numbers that says how often a row counts.

    Distinct values are counted, ranked by running sums and picked by rank. A built-in percentile keeps every
    distinct value of a group in one task's memory; here a group may have any number of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v__")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n__"))
    counts = stage(counts, "values")  # read three times
    ranked = running_sums(counts, [F.col("v__")], {"upto__": F.col("n__")}, keys=keys)
    totals = counts.groupBy(*keys).agg(F.sum("n__").alias("total__"))
    both = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto__") - F.col("n__") <= rank) & (rank < F.col("upto__")), F.col("v__")))

    aggs = []
    for k, p in enumerate(probs.values()):
        h = (F.col("total__") - 1) * F.lit(p)
        aggs += [at(F.floor(h)).alias(f"lo{k}"), at(F.ceil(h)).alias(f"hi{k}"), F.max(h - F.floor(h)).alias(f"w{k}")]
    out = both.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"w{k}")).alias(n) for k, n in enumerate(probs)))


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float], ids: list[str] | None = None) -> DataFrame:
    """column_name (and ids), a column for each probability, over all the columns at once."""
    ids = ids or []
    long = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(ids, columns, "column_name", "value")
    return grouped_quantiles(long, ["column_name", *ids], "value", probs)


def quantile_edges(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """The same as numbers on the driver: one list a column."""
    rows = column_quantiles(df, columns, {f"q{k}": p for k, p in enumerate(probs)}).collect()
    return {r["column_name"]: [r[f"q{k}"] for k in range(len(probs))] for r in rows}
