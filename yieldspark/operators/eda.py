"""Exploratory statistics that decide what a pipeline keeps."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from yieldspark.operators.moments import known_pairs
from yieldspark.operators.ordering import column_quantiles, look_around, look_back, quantile_edges, running_sums
from yieldspark.operators.quality import long_form
from yieldspark.sources.staging import BROADCAST_ROWS, checked, stage

#: Columns whose ranks rows take side by side.
WIDE = 16


def shape_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, skew and excess kurtosis with the small-sample correction, pct_zeros."""
    wide = []
    for c in columns:
        v = F.col(c).cast("double")
        n = F.count(v).cast("double")
        g1, g2 = F.skewness(v), F.kurtosis(v)
        wide.append(
            F.struct(
                F.count(v).alias("n"),
                F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
                F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
                F.avg((v == 0).cast("double")).alias("pct_zeros"),
            ).alias(c)
        )
    return df.agg(*wide).unpivot([], columns, "column_name", "s").select("column_name", "s.*")


def shape_flags(stats: DataFrame, skew: float = 2.0, kurtosis: float = 7.0, zeros: float = 0.5) -> DataFrame:
    flags = {"skewed": F.abs("skew") > skew, "heavy_tailed": F.col("kurtosis") > kurtosis, "zero_inflated": F.col("pct_zeros") > zeros}
    return stats.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def mid_ranks(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, before): counts of each distinct value and of the rows before it; mid-rank = before + (n + 1) / 2.

    weight names a column that says how often a row counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    out = running_sums(stage(counts, "values"), [F.col(value)], {"before": F.col("n")}, keys=keys)
    return out.withColumn("before", F.col("before") - F.col("n")).withColumn("mid_rank", F.col("before") + (F.col("n") + 1) / 2)


def mann_whitney(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column_name, u (of the label's class 1), z and two-sided p with tie correction and continuity 0.5."""
    rows = long_form(df, columns, [label]).where("value is not null")
    one = F.count_if(F.col(label) == 1)
    counts = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), one.alias("n1"))
    ranked = running_sums(stage(counts, "values"), [F.col("value")], {"upto": F.col("n")}, keys=["column_name"]).withColumn("mid", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.groupBy("column_name").agg(F.sum("n").cast("double").alias("n"), F.sum("n1").cast("double").alias("n1"), F.sum(F.col("n1") * F.col("mid")).alias("r1"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(sd > 0, F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)) / sd)
    return s.select("column_name", u.alias("u"), z.alias("z")).withColumn("p", two_sided(F.col("z")))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of the error function (absolute error under 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(terms[-1])
    for c in terms[-2::-1]:
        poly = F.lit(c) + t * poly
    return F.when(z.isNotNull(), F.least(t * F.exp(-x * x + poly), F.lit(1.0)))


def benjamini_hochberg(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """tests with q: the least p * m / rank among itself and all larger p (nulls stay null). A row a test."""
    known = tests.where(F.col(p).isNotNull())
    up = Window.orderBy(p, key)
    whole = Window.partitionBy(F.lit(0))
    raw = known.withColumn("raw__", F.col(p) * F.count(F.lit(1)).over(whole) / F.row_number().over(up))
    q = raw.withColumn("q", F.least(F.lit(1.0), F.min("raw__").over(Window.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)))).select(key, "q")
    return tests.join(q, key, "left")


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column_name, rho: correlation of mid-ranks over rows where both are known.

    Columns are ranked by their counted values, rows take their ranks wide, and the target's distinct values, in
    order, carry for each column how many rows know it and the sum of their ranks: running counts rank the target
    for all columns at once, and nothing is joined on it.
    """
    parts = [_spearman(df, columns[k : k + WIDE], target) for k in range(0, len(columns), WIDE)]
    return functools.reduce(DataFrame.unionByName, parts)


def _spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    known = df.where(F.col(target).isNotNull())
    # a value that all columns' rows share is counted before it is dealt, so it is no single task
    ranks = mid_ranks(long_form(known, columns, []), ["column_name"], "value")
    ranks = stage(ranks.select("column_name", "value", "n", F.col("mid_rank").alias("rank")), "ranks")
    sizes = {r["column_name"]: (r["n"], r["values"]) for r in ranks.groupBy("column_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()}
    names = [c for c in columns if c in sizes]
    if not names:
        return ranks.select("column_name", F.col("rank").alias("rho"))
    wide = known.select(F.col(target).alias("t__"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)))
    for k, c in enumerate(names):
        mine = ranks.where(F.col("column_name") == c).select(F.col("value").alias(f"x{k}"), (F.col("rank") - (sizes[c][0] + 1) / 2).alias(f"r{k}"))
        wide = wide.join(F.broadcast(mine) if sizes[c][1] <= BROADCAST_ROWS else mine, f"x{k}", "left")
    every = range(len(names))
    targets = wide.groupBy("t__").agg(*(F.count(f"r{k}").alias(f"n{k}") for k in every), *(F.sum(f"r{k}").alias(f"s{k}") for k in every))
    upto = running_sums(stage(targets, "targets"), [F.col("t__")], {f"u{k}": F.col(f"n{k}") for k in every})
    sums = []
    for k, c in enumerate(names):
        n = F.col(f"n{k}")
        y = F.col(f"u{k}") - n + (n + 1) / 2 - (sizes[c][0] + 1) / 2
        sums.append(F.struct(F.sum(y * F.col(f"s{k}")).alias("cov"), F.sum(n * y**2).alias("vy")).alias(c))
    middle = F.element_at(F.create_map(*(F.lit(v) for c in names for v in (c, (sizes[c][0] + 1) / 2))), F.col("column_name"))
    spread = ranks.groupBy("column_name").agg(F.sum(F.col("n") * (F.col("rank") - middle) ** 2).alias("vx"))
    out = upto.agg(*sums).unpivot([], names, "column_name", "s").join(spread, "column_name")
    return out.select("column_name", F.when((F.col("vx") > 0) & (F.col("s.vy") > 0), F.col("s.cov") / F.sqrt(F.col("vx") * F.col("s.vy"))).alias("rho"))


def tail_enrichment(df: DataFrame, columns: list[str], label: str, q: float = 0.95) -> DataFrame:
    """column_name, base_rate, upper and lower: fail rate beyond the q and 1 - q quantiles over the base rate."""
    edges, y, wide = quantile_edges(df, columns, [1 - q, q]), F.col(label).cast("double"), []
    for c in columns:
        low, high = edges.get(c, [None, None])
        base = F.avg(F.when(F.col(c).isNotNull(), y))
        wide.append(F.struct(base.alias("base_rate"), (F.avg(F.when(F.col(c) > F.lit(high), y)) / base).alias("upper"), (F.avg(F.when(F.col(c) < F.lit(low), y)) / base).alias("lower")).alias(c))
    return df.agg(*wide).unpivot([], columns, "column_name", "s").select("column_name", "s.*")


def variance_ratios(df: DataFrame, columns: list[str], label: str, clip: float = 0.01) -> DataFrame:
    """column_name and the class 1 to class 0 ratio of variances, of variances clipped at quantiles, and of IQRs."""
    edges, y, wide = quantile_edges(df, columns, [clip, 1 - clip]), F.col(label) == 1, []
    var = lambda on, x: F.var_samp(F.when(on, x))
    safe = lambda a, b: F.when(b > 0, a / b)
    for c in columns:
        low, high = edges.get(c, [None, None])
        v = F.col(c).cast("double")
        cut = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))
        wide.append(F.struct(safe(var(y, v), var(~y, v)).alias("raw"), safe(var(y, cut), var(~y, cut)).alias("clipped")).alias(c))
    ratios = df.agg(*wide).unpivot([], columns, "column_name", "s").select("column_name", "s.*")
    spread = column_quantiles(df.where(F.col(label).isNotNull()), columns, {"a": 0.25, "b": 0.75}, [label]).withColumn("w", F.col("b") - F.col("a"))
    one, zero = F.max(F.when(y, F.col("w"))), F.max(F.when(~y, F.col("w")))
    return ratios.join(spread.groupBy("column_name").agg(safe(one, zero).alias("iqr")), "column_name", "left")


def missing_gap(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column_name, gap: missing share in class 1 less that in class 0."""
    y = F.col(label) == 1
    wide = df.agg(*((F.avg(F.when(y, F.col(c).isNull().cast("double"))) - F.avg(F.when(~y, F.col(c).isNull().cast("double")))).alias(c) for c in columns))
    return wide.unpivot([], columns, "column_name", "gap")


def dropout_cliques(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """column_name, n_missing, clique: columns missing on exactly the same rows share a clique (its first column).

    Two columns co-miss perfectly if and only if their null masks are equal, so an order-free hash of the
    keys of null rows groups them in one pass; columns without nulls are left out.
    """
    masks = df.agg(*(F.struct(F.sum(F.col(c).isNull().cast("long")).alias("n"), F.bit_xor(F.when(F.col(c).isNull(), F.xxhash64(key))).alias("h")).alias(c) for c in columns))
    rows = masks.unpivot([], columns, "column_name", "m").where("m.n > 0")
    return rows.select("column_name", F.col("m.n").alias("n_missing"), F.min("column_name").over(Window.partitionBy("m.n", "m.h")).alias("clique"))


def dropout_groups(df: DataFrame, columns: list[str], least: float = 0.999) -> DataFrame:
    """column_name, n_missing, group, n_columns: columns whose null masks correlate by `least` or more share a
    group, named by its first column, as do all that are linked so in steps. Columns without nulls are left out;
    a column that is null throughout stands alone.

    Correlations come from counts of rows on which two columns are known; labels spread over the links (a
    table of columns) until none changes.
    """
    columns = sorted(columns)
    names = F.array(*map(F.lit, columns))
    total = F.lit(float(df.count()))
    pairs = stage(known_pairs(df, columns), "known_pairs")
    nulls = pairs.where("i = j").select(F.col("i").alias("c"), (total - F.col("n")).alias("nulls")).where("nulls > 0")
    side = lambda c: F.broadcast(nulls.select(F.col("c").alias(c), F.col("nulls").alias(f"n{c}")))
    ni, nj = F.col("ni"), F.col("nj")
    both = ni + nj + F.col("n") - total  # rows on which both are null
    r = (total * both - ni * nj) / F.sqrt(ni * (total - ni) * nj * (total - nj))
    links = pairs.where("i < j").join(side("i"), "i").join(side("j"), "j").where((ni < total) & (nj < total)).where(r >= least).select("i", "j")
    links = stage(links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))), "links")
    labels = stage(nulls.select("c", F.col("c").alias("label"), "nulls"), "labels")
    while True:
        low = links.join(labels.select(F.col("c").alias("j"), F.col("label").alias("low")), "j").groupBy(F.col("i").alias("c")).agg(F.min("low").alias("low"))
        moved = stage(labels.join(low, "c", "left").select("c", F.least("label", "low").alias("label"), "nulls", (F.col("low") < F.col("label")).alias("changed")), "labels")
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            break
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return labels.select(F.get(names, F.col("c")).alias("column_name"), F.col("nulls").cast("long").alias("n_missing"), F.get(names, F.col("label")).alias("group"), size.alias("n_columns"))


def _two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the tables of equal margins no likelier than the seen one: two tails, each summed outward until nothing is left."""
    row, col, n = a + b, a + c, a + b + c + d
    if not n:
        return 1.0
    low, high = max(0, row + col - n), min(row, col)
    of = lambda *xs: sum(math.lgamma(x + 1) for x in xs)
    log = lambda x: of(row, n - row, col, n - col) - of(n, x, row - x, col - x, n - row - col + x)
    seen, mode, total = log(a) + 1e-7, min(high, max(low, (row + 1) * (col + 1) // (n + 2))), 0.0
    for step, near, far in ((-1, mode, low), (1, mode + 1, high)):
        inside, outside = near - step, far + step  # first place no likelier than the seen table, by halving
        while abs(outside - inside) > 1:
            middle = (inside + outside) // 2
            inside, outside = (inside, middle) if log(middle) <= seen else (middle, outside)
        at = outside
        while (far - at) * step >= 0:
            x = np.arange(at, at + step * min(4096, abs(far - at) + 1), step, dtype=float)
            up = np.log((row - x[:-1]) * (col - x[:-1])) - np.log((x[:-1] + 1) * (n - row - col + x[:-1] + 1)) if step > 0 else np.log(x[:-1] * (n - row - col + x[:-1])) - np.log((row - x[:-1] + 1) * (col - x[:-1] + 1))
            more = float(np.exp(log(at) + np.concatenate([[0.0], np.cumsum(up)])).sum())
            total, at = total + more, at + step * len(x)
            if more < 1e-17 * total:
                break
    return min(1.0, total)


def fisher_exact(tables: DataFrame, key: str) -> DataFrame:
    """key, p: two-sided Fisher test of the 2 x 2 counts a, b, c, d (sum of tables no likelier than the seen one).

    A row of any counts takes a few thousand terms, not one for each table of its margins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t[[key]].assign(p=[_two_sided(*map(int, x)) for x in t[["a", "b", "c", "d"]].itertuples(index=False)])

    return tables.select(key, "a", "b", "c", "d").mapInPandas(run, f"{key} {dict(tables.dtypes)[key]}, p double")


def group_offset(rows: DataFrame, keys: list[str], value: str, name: str = "offset") -> DataFrame:
    """rows with value less its group's least value; null where the value is."""
    least = checked(rows.groupBy(*keys).agg(F.min(value).alias("least__")), "least")
    return rows.join(least, keys, "left").withColumn(name, F.col(value) - F.col("least__")).drop("least__")


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 32) -> DataFrame:
    """column_name, mi: mutual information (nats) of each column, in quantile bins, with a discrete label.

    Quantile bins replace nearest-neighbour estimates: counts add up over any number of rows.
    """
    edges = quantile_edges(df, columns, [k / bins for k in range(1, bins)])
    place = lambda c: F.when(F.col(c).isNotNull(), sum(((F.col(c) > e).cast("int") for e in edges.get(c, [])), F.lit(0)))
    binned = df.select(F.col(label).alias("y"), *(place(c).alias(c) for c in columns))
    cells = binned.unpivot(["y"], columns, "column_name", "x").where("x is not null").groupBy("column_name", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("column_name", *k))
    cells = cells.select("column_name", "n", by().alias("all"), by("x").alias("nx"), by("y").alias("ny"))
    return cells.groupBy("column_name").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi"))


def digamma(n: Column) -> Column:
    """Of a number of 1 or more: by recurrence to 6 and above, then the asymptotic series."""
    y = n + 6
    t = 1 / (y * y)
    series = t * (F.lit(1 / 12) - t * (F.lit(1 / 120) - t * (F.lit(1 / 252) - t * (F.lit(1 / 240) - t * F.lit(1 / 132)))))
    return F.log(y) - 0.5 / y - series - sum((1 / (n + k) for k in range(6)), F.lit(0.0))


def neighbour_information(df: DataFrame, columns: list[str], label: str, k: int = 5) -> DataFrame:
    """column_name, n, mi: nearest-neighbour mutual information (nats) of each column with a discrete label.

    For each row the distance to the k-th nearest row of its class (to the farthest in smaller ones) and the
    number of rows of all classes nearer than that, its own included (equal ones, where that distance is 0):
    mi = psi(n) + mean(psi(k) - psi(class size) - psi(number)), 0 at least. Nulls, and rows that are alone in
    their class, are left out; null where none is left. Columns are sorted in ranges: windows reach k rows to
    either side, and the counts are running sums over the values and the ends of the rows' intervals.
    """
    rows = long_form(df, columns, [label]).where(f"value is not null and not isnan(value) and {label} is not null").withColumnRenamed(label, "y")
    sizes = stage(rows.groupBy("column_name", "y").agg(F.count(F.lit(1)).alias("size"), F.min("value").alias("least"), F.max("value").alias("most")), "classes")
    sizes = checked(sizes.where("size > 1"), "classes")
    rows = stage(rows.join(sizes, ["column_name", "y"]).withColumn("id", F.monotonically_increasing_id()), "values")
    x = F.col("value")

    def around(w: WindowSpec) -> dict[str, Column]:
        before = [x, *(F.lag("value", j).over(w) for j in range(1, k + 1))]
        after = [x, *(F.lead("value", j).over(w) for j in range(1, k + 1))]
        # the k nearest are k + 1 rows in a row, j of them before this one
        runs = [F.when(before[j].isNotNull() & after[k - j].isNotNull(), F.struct(F.greatest(x - before[j], after[k - j] - x).alias("d"), before[j].alias("low"), after[k - j].alias("high"))) for j in range(k + 1)]
        return {"run": F.array_min(F.array_compact(F.array(*runs)))}

    placed = look_around(rows, ["column_name", "y"], ["value", "id"], k, around)
    few = F.struct(F.greatest(x - F.col("least"), F.col("most") - x).alias("d"), F.col("least").alias("low"), F.col("most").alias("high"))
    run = F.when(F.col("size") > k, F.col("run")).otherwise(few)
    points = placed.select("column_name", "y", "size", "value", run.alias("run")).groupBy("column_name", "y", "size", "value").agg(F.first("run").alias("run"), F.count(F.lit(1)).alias("w"))  # equal rows of a class have one run
    d, low, high = F.col("run.d"), F.col("run.low"), F.col("run.high")
    # an end that is a row at distance d is that row's value itself, so that rounding cannot move it
    left = F.when(x - low == d, low).otherwise(x - d)
    right = F.when(high - x == d, high).otherwise(x + d)
    points = stage(points.select("column_name", "size", "w", F.monotonically_increasing_id().alias("id"), "value", (d == 0).alias("tied"), left.alias("left"), right.alias("right")), "points")
    # order at one value: ends that leave it out on the left, rows, ends that take it in
    ends = points.select("column_name", "id", F.explode(F.array(F.struct(F.col("right").alias("value"), F.when(F.col("tied"), 2).otherwise(0).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("left").alias("value"), F.when(F.col("tied"), 0).otherwise(2).alias("at"), F.lit(-1).alias("sign")))).alias("e"))
    ends = ends.select("column_name", F.col("e.value").alias("value"), F.col("e.at").alias("at"), "id", F.col("e.sign").alias("sign"), F.lit(0).cast("long").alias("n"))
    data = points.select("column_name", "value", F.lit(1).alias("at"), "id", F.lit(0).alias("sign"), F.col("w").alias("n"))
    merged = running_sums(stage(data.unionByName(ends), "ends"), [F.col("value"), F.col("at"), F.col("id"), F.col("sign")], {"upto": F.col("n")}, keys=["column_name"])
    number = merged.where("sign != 0").groupBy("column_name", "id").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    both = points.join(number, ["column_name", "id"])
    neighbours = F.least(F.col("size") - 1, F.lit(k))
    term = F.col("w") * (digamma(neighbours) - digamma(F.col("size")) - digamma(F.col("m")))
    return both.groupBy("column_name").agg(F.sum("w").alias("n"), F.sum(term).alias("t")).select("column_name", "n", F.greatest(digamma(F.col("n")) + F.col("t") / F.col("n"), F.lit(0.0)).alias("mi"))


def rolling_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int = 10) -> DataFrame:
    """rows with the mean of the last `window` rows, null until that many values are there."""

    def mean(w: WindowSpec) -> dict[str, Column]:
        last = w.rowsBetween(1 - window, 0)
        return {"rolling_mean": F.when(F.count(value).over(last) == window, F.avg(value).over(last))}

    return look_back(rows, keys, order, window - 1, mean)
