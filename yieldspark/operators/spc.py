"""Statistical process control over a long table (sensor, order columns, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from yieldspark.functions.stats import binomial_limits
from yieldspark.operators.ordering import grouped_quantiles, look_back, positions, row_ranges
from yieldspark.sources.staging import checked, stage

# MAD to sigma, d2 of a range of 2, D4 of a moving range.
MAD_SIGMA, D2, D4 = 1.4826, 1.128, 3.267
MIN_OBSERVED = 25
#: Rows of one sensor that an EWMA task folds.
BLOCK = 100_000


def moving_range(rows: DataFrame, value: str, sensor: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with mr: |x - previous x|; null on the first row and on both sides of a gap."""
    return look_back(rows, sensor, order, 1, lambda w: {"mr": F.abs(F.col(value) - F.lag(value).over(w))}, ranges)


def control_limits(rows: DataFrame, sensor: str, value: str, order: list[str], method: str = "robust", k: float = 3.0, ranges: int | None = None) -> DataFrame:
    """Frozen limits of each sensor from the rows given (phase I only).

    robust: median and 1.4826 * MAD; classic: mean and mean moving range / 1.128. Moving ranges are over
    observed values (nulls leave no gap). Under 25 observations, or sigma not over 0: degenerate, no limits.
    """
    seen = rows.where(F.col(value).isNotNull()).select(sensor, *order, F.col(value).alias("x"))
    seen = moving_range(seen, "x", [sensor], order, ranges)
    if method == "robust":
        seen = stage(seen.select(sensor, "x", "mr"), "observed")  # read twice
    first = seen.groupBy(sensor).agg(F.count(F.lit(1)).alias("n_obs"), F.avg("x").alias("mean"), F.avg("mr").alias("mr_bar"))
    if method == "robust":
        counts = stage(seen.groupBy(sensor, "x").agg(F.count(F.lit(1)).alias("n")), "observed_values")
        middle = checked(grouped_quantiles(counts, [sensor], "x", {"median": 0.5}, "n"), "medians")
        spread = counts.join(middle, sensor).select(sensor, F.abs(F.col("x") - F.col("median")).alias("d"), "n")
        first = first.join(middle, sensor).join(grouped_quantiles(spread, [sensor], "d", {"mad": 0.5}, "n"), sensor).withColumns({"center": F.col("median"), "sigma": MAD_SIGMA * F.col("mad")})
    elif method == "classic":
        first = first.withColumns({"center": F.col("mean"), "sigma": F.col("mr_bar") / D2})
    else:
        raise ValueError(f"unknown method {method}")
    bad = (F.col("n_obs") < MIN_OBSERVED) | ~F.coalesce(F.col("sigma") > 0, F.lit(False))
    keep = lambda c: F.when(~bad, c)
    return first.select(
        sensor, keep(F.col("center")).alias("center"), keep(F.col("sigma")).alias("sigma"),
        keep(F.col("center") - k * F.col("sigma")).alias("lcl"), keep(F.col("center") + k * F.col("sigma")).alias("ucl"),
        keep(F.col("mr_bar")).alias("mr_bar"), keep(D4 * F.col("mr_bar")).alias("mr_ucl"), bad.alias("degenerate"),
    )


def ewma(rows: DataFrame, sensor: str, value: str, order: list[str], seed: Column, lam: float = 0.2, ranges: int | None = None) -> DataFrame:
    """rows with ewma: z = lam * x + (1 - lam) * z, from seed; a null carries z, and a null seed gives null.

    A sensor's series is cut in blocks: each block folds from zero on its own, the blocks' ends are chained
    (a row a block), and each block adds its start, decayed. No task holds a whole series.
    """
    if {"pos__", "block__", "seed__", "z__"} & set(rows.columns):
        raise ValueError("column names with __ are reserved")
    cut = positions(rows.withColumn("seed__", seed.cast("double")), [F.col(c) for c in order], "pos__", ranges, [sensor]).withColumn("block__", F.floor(F.col("pos__") / BLOCK))
    keep = 1 - lam

    def fold(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From zero: the local sums, and the number of values seen, at every row."""
        seen = ~np.isnan(x)
        counts = np.cumsum(seen)
        values, out, last, step = x[seen], np.empty(int(seen.sum())), 0.0, 64
        lower = lam * keep ** np.subtract.outer(np.arange(step), np.arange(step)).clip(0) * np.tri(step)
        for k in range(0, len(values), step):
            part = values[k : k + step]
            n = len(part)
            out[k : k + n] = lower[:n, :n] @ part + last * keep ** np.arange(1, n + 1)
            last = out[k + n - 1]
        return np.append(0.0, out)[counts], counts

    def ends(part: pa.Table) -> pa.Table:
        x = part.sort_by("pos__")["x"].to_numpy()
        z, n = fold(x)
        return pa.table({sensor: part[sensor].slice(0, 1), "block__": part["block__"].slice(0, 1), "end": [float(z[-1])], "seen": [int(n[-1])]})

    kind = dict(rows.dtypes)[sensor]
    narrow = cut.select(sensor, "block__", "pos__", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x"))
    done = narrow.groupBy(sensor, "block__").applyInArrow(ends, f"{sensor} {kind}, block__ long, end double, seen long")
    # a block of so many values that the start has decayed to 0 begins a chain anew, so chains stay short
    blocks = Window.partitionBy(sensor).orderBy("block__")
    done = done.withColumn("chain__", F.sum((F.pow(F.lit(keep), "seen") == 0).cast("int")).over(blocks))
    upto = Window.partitionBy(sensor, "chain__").orderBy("block__").rowsBetween(Window.unboundedPreceding, 0)
    chain = F.aggregate(F.collect_list(F.struct("end", "seen")).over(upto), F.lit(0.0), lambda z, b: z * F.pow(F.lit(keep), b["seen"]) + b["end"])
    done = done.withColumn("z__", chain)
    starts = done.select(sensor, "block__", F.coalesce(F.lag("z__").over(blocks), F.lit(0.0)).alias("z__"), F.coalesce(F.sum("seen").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n__"))
    fields = rows.schema
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def finish(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos__")
        z, n = fold(part["x__"].to_numpy())
        start, seen, first = part["z__"][0].as_py(), part["n__"][0].as_py(), part["seed__"][0].as_py()
        full = z + keep**n * (start + (keep**seen * first if first is not None else np.nan))
        return part.select([f.name for f in fields]).append_column("ewma", pa.array(full, mask=np.isnan(full)))

    whole = cut.join(starts, [sensor, "block__"]).withColumn("x__", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
    return whole.groupBy(sensor, "block__").applyInArrow(finish, f"{own}, ewma double")


def ewma_limits(center: Column, sigma: Column, lam: float = 0.2, k: float = 3.0) -> tuple[Column, Column]:
    """Asymptotic limits."""
    half = k * sigma * (lam / (2 - lam)) ** 0.5
    return center - half, center + half


def western_electric(rows: DataFrame, sensor: list[str], order: list[str], z: Column, ranges: int | None = None) -> DataFrame:
    """rows with r1..r4 at each point: beyond 3; 2 of 3 beyond 2 on its side; 4 of 5 beyond 1; 8 on one side.

    z is the standardised value; a null or an exact 0 breaks runs.
    """
    rows = rows.withColumn("z__", z)
    z = F.col("z__")

    def rules(w: WindowSpec) -> dict[str, Column]:
        def zone(limit: float, n: int, least: int) -> Column:
            sides = [(s * z > limit) & (F.sum(F.coalesce((s * z > limit).cast("int"), F.lit(0))).over(w.rowsBetween(1 - n, 0)) >= least) for s in (1, -1)]
            return F.coalesce(sides[0] | sides[1], F.lit(False))

        return {"r1": F.coalesce(F.abs(z) > 3, F.lit(False)), "r2": zone(2, 3, 2), "r3": zone(1, 5, 4), "r4": zone(0, 8, 8)}

    return look_back(rows, sensor, order, 7, rules, ranges).drop("z__")


def imr_series(rows: DataFrame, limits: DataFrame, sensor: str, value: str, order: list[str], lam: float = 0.2) -> DataFrame:
    """The chart table: value, mr (positional), ewma and its limits, r1..r4."""
    ranges = row_ranges(rows)
    joined = rows.select(sensor, *order, F.col(value).cast("double").alias("value")).join(checked(limits.select(sensor, "center", "sigma"), "limits"), sensor)
    low, high = ewma_limits(F.col("center"), F.col("sigma"), lam)
    out = moving_range(ewma(joined, sensor, "value", order, F.col("center"), lam, ranges), "value", [sensor], order, ranges).withColumns({"ewma_lcl": low, "ewma_ucl": high})
    return western_electric(out, [sensor], order, (F.col("value") - F.col("center")) / F.col("sigma"), ranges).drop("center", "sigma")


def screening(rows: DataFrame, sensor: str, value: str, order: list[str], phase2: Column, tail: Column, method: str = "robust", k: float = 3.0, lam: float = 0.2) -> DataFrame:
    """Per sensor: out-of-control, EWMA alarm and missing rates in phase I, phase II (tail included) and tail.

    Limits are frozen on phase I. OOC rates are over observed rows, EWMA rates over all rows; an empty phase
    is null; a degenerate sensor has no rates but its missing ones. delta = p2 - p1.
    """
    flagged = stage(rows.select(sensor, *order, F.col(value).cast("double").alias("x"), phase2.alias("p2"), tail.alias("tail")), "screened")
    ranges = row_ranges(flagged)
    limits = control_limits(flagged.where(~F.col("p2")), sensor, "x", order, method, k, ranges)
    joined = ewma(flagged.join(checked(limits, "limits"), sensor, "left"), sensor, "x", order, F.col("center"), lam, ranges)
    low, high = ewma_limits(F.col("center"), F.col("sigma"), lam, k)
    ok = ~F.col("degenerate")
    out_of, alarm = ((F.col("x") < F.col("lcl")) | (F.col("x") > F.col("ucl"))), ((F.col("ewma") < low) | (F.col("ewma") > high))
    aggs = []
    for name, phase in {"p1": ~F.col("p2"), "p2": F.col("p2"), "tail": F.col("tail")}.items():
        aggs += [
            F.avg(F.when(phase & ok & F.col("x").isNotNull(), out_of.cast("double"))).alias(f"ooc_{name}"),
            F.avg(F.when(phase & ok, F.coalesce(alarm, F.lit(False)).cast("double"))).alias(f"ewma_{name}"),
            F.avg(F.when(phase, F.col("x").isNull().cast("double"))).alias(f"miss_{name}"),
        ]
    out = joined.groupBy(sensor).agg(F.first("degenerate").alias("degenerate"), *aggs)
    return out.withColumns({"delta": F.col("ooc_p2") - F.col("ooc_p1"), "ewma_delta": F.col("ewma_p2") - F.col("ewma_p1")})


def windowed_rate(rows: DataFrame, position: str, flag: Column, window: int = 50, start: int = 0) -> DataFrame:
    """x (right edge), n, rate of consecutive windows of positions; the last may be short and keeps its n."""
    at = F.col(position) - start
    groups = rows.where(at >= 0).groupBy(F.floor(at / window).cast("long").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return groups.select("w", (F.col("w") * window + F.col("n") + start).cast("long").alias("x"), "n", "rate")


def p_chart(rows: DataFrame, position: str, flag: Column, phase1: Column, window: int = 50, k: float = 3.0) -> DataFrame:
    """windowed_rate with p0 of phase I, limits at each window's own n, and alarm (rate > ucl)."""
    p0 = rows.where(phase1).agg(F.avg(flag.cast("double")).alias("p0"))
    out = windowed_rate(rows, position, flag, window).crossJoin(F.broadcast(p0))
    low, high = binomial_limits(F.col("p0"), F.col("n"), k)
    return out.withColumns({"lcl": low, "ucl": high}).withColumn("alarm", F.col("rate") > F.col("ucl"))


def showcase(table: DataFrame, sensor: str, n: int = 4, min_delta: float = 0.05) -> DataFrame:
    """A 2 x 2 pick by (stable, drifting): up to n stable drifting (delta down), then up to 2 stable calm (delta
    up), then up to 2 other drifting (delta down); topped up by delta where fewer than n. table: sensor, delta,
    stable, a row a sensor; null deltas are left out."""
    cell = F.when(F.col("stable") & (F.col("delta") >= min_delta), 0).when(F.col("stable"), 1).when(F.col("delta") >= min_delta, 2).otherwise(3)
    rows = table.where("delta is not null").withColumn("cell", cell)
    key = F.when(F.col("cell") == 1, F.col("delta")).otherwise(-F.col("delta"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(key, sensor)))
    quota = F.when(F.col("cell") == 0, n).when(F.col("cell") == 3, 0).otherwise(2)
    rows = rows.withColumn("picked", F.col("place") <= quota)
    total = rows.agg(F.sum(F.col("picked").cast("int")).alias("total"))
    rest = Window.partitionBy("picked").orderBy(F.desc("delta"), sensor)  # a row a sensor
    rows = rows.withColumn("rest", F.row_number().over(rest)).crossJoin(F.broadcast(total))
    return rows.where(F.col("picked") | (F.col("rest") <= n - F.col("total"))).select(sensor, "delta", "stable", F.when(F.col("picked"), F.col("cell")).otherwise(9).cast("long").alias("cell"), F.when(F.col("picked"), F.col("place")).otherwise(F.col("rest")).cast("long").alias("place"))


def stable_set(counts: DataFrame, sensor: str, count: str) -> DataFrame:
    """Selection counts as shares; where any is over 1.5 they are divided by the largest."""
    most = counts.agg(F.max(count).alias("most__"))
    out = counts.crossJoin(F.broadcast(most))
    return out.select(sensor, F.when(F.col("most__") > 1.5, F.col(count) / F.col("most__")).otherwise(F.col(count).cast("double")).alias("stability"))


def protocol_charts(rows: DataFrame, position: str, flags: list[str], phase1: Column, window: int = 50, k: float = 3.0) -> DataFrame:
    """p-charts of several 0/1 columns on one grid: feature, w, x, n, rate, p0, lcl, ucl, alarm, in one pass each side."""
    long = rows.select(position, phase1.alias("p1__"), *(F.col(f).cast("double").alias(f) for f in flags)).unpivot([position, "p1__"], flags, "feature", "v")
    p0 = long.where("p1__").groupBy("feature").agg(F.avg("v").alias("p0"))
    cells = long.groupBy("feature", F.floor(F.col(position) / window).cast("long").alias("w")).agg((F.max(position) + 1).cast("long").alias("x"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("rate"))
    low, high = binomial_limits(F.col("p0"), F.col("n"), k)
    out = cells.join(F.broadcast(p0), "feature").withColumns({"lcl": low, "ucl": high})
    return out.withColumn("alarm", F.col("rate") > F.col("ucl"))
