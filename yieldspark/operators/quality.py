"""Column-quality screening: statistics by column, ordered rules, correlation pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldspark.operators.moments import pair_sums

# Thresholds of the rules.
MAX_MISSING, MAX_DOMINANT, MIN_CV, MIN_UNIQUE = 0.5, 0.99, 0.01, 5
RESCUE_DEVIANT, RESCUE_ENRICHMENT, MAX_CORR = 5, 2.0, 0.95


def long_form(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """column_name, value (double) for each of the columns, ids carried."""
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(ids, columns, "column_name", "value")


def column_quality(df: DataFrame, columns: list[str], fail: str) -> DataFrame:
    """Per column: missing, n_unique, mean, std, cv, dominant value and share, deviants and their enrichment.

    Values are counted first (column, value), so the second grouping sees distinct values only. Of equally
    frequent dominant values the least is taken.
    """
    rows = long_form(df, columns, [fail])
    y = F.col(fail).cast("double")
    values = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("fails"))
    known = F.col("value").isNotNull()
    n = F.when(known, F.col("n"))
    head = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum("fails").alias("all_fails"), F.sum(n).alias("n_obs"), F.count("value").alias("n_unique"),
        F.max_by(F.struct("value", "n", "fails"), F.when(known, F.struct(F.col("n"), -F.col("value")))).alias("top"),
        F.sum(F.when(known, F.col("fails"))).alias("obs_fails"),
    )
    moments = df.agg(*(F.struct(F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std")).alias(c) for c in columns)).unpivot([], columns, "column_name", "m")
    base = F.col("all_fails") / F.col("n_rows")
    deviants = F.coalesce(F.col("n_obs"), F.lit(0)) - F.coalesce(F.col("top.n"), F.lit(0))
    rate = F.when(deviants > 0, (F.col("obs_fails") - F.col("top.fails")) / deviants)
    out = head.join(moments, "column_name").select(
        "column_name", (1 - F.coalesce(F.col("n_obs"), F.lit(0)) / F.col("n_rows")).alias("missing"), F.col("n_unique").cast("long").alias("n_unique"),
        F.col("m.mean").alias("mean"), F.col("m.std").alias("std"),
        F.when(F.abs("m.mean") > 1e-12, F.abs(F.col("m.std") / F.col("m.mean"))).alias("cv"),
        F.col("top.value").alias("dom_value"), (F.col("top.n") / F.col("n_obs")).alias("dom_frac"),
        deviants.cast("long").alias("n_deviant"), F.when(base > 0, rate / base).alias("enrichment"),
    )
    return out


def verdicts(quality: DataFrame) -> DataFrame:
    """Ordered rules: constant, missing, near-zero variance (unless its deviants are rescued), else keep."""
    nzv = F.coalesce(F.col("dom_frac") > MAX_DOMINANT, F.lit(False)) | F.coalesce(F.col("cv") < MIN_CV, F.lit(False)) | (F.col("n_unique") < MIN_UNIQUE)
    rescue = (F.col("n_deviant") >= RESCUE_DEVIANT) & F.coalesce(F.col("enrichment") >= RESCUE_ENRICHMENT, F.lit(False))
    rule = F.when(F.col("n_unique") == 1, "constant").when(F.col("missing") > MAX_MISSING, "missing").when(nzv & ~rescue, "near_zero_variance").otherwise("keep")
    return quality.withColumn("verdict", rule)


def pairwise_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b (a < b), n, r: Pearson over rows where both are known, all pairs in one pass, in blocks of columns.

    Masked cross products of columns centred on their means; null where fewer than two rows or no spread.
    """
    columns = sorted(columns)
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    centred = df.select(*((F.col(c).cast("double") - F.lit(float(means[c] or 0.0))).alias(c) for c in columns))

    def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        return np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])

    s = pair_sums(centred, columns, products, [f"s{q}" for q in range(6)]).where("i < j")
    n = F.col("s0")
    cov, va, vb = F.col("s5") - F.col("s1") * F.col("s2") / n, F.col("s3") - F.col("s1") ** 2 / n, F.col("s4") - F.col("s2") ** 2 / n
    names = F.array(*map(F.lit, columns))
    r = F.when((n > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    return s.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), n.cast("long").alias("n"), r.alias("r"))


def prune_correlated(pairs: DataFrame, missing: dict[str, float], limit: float = MAX_CORR) -> list[str]:
    """Greedy: pairs by |r| descending; of two columns still kept, the one more missing goes (a tie: a).

    Only pairs over the limit come to the driver, where the order makes the loop sequential.
    """
    dropped: list[str] = []
    for a, b in ((r["a"], r["b"]) for r in pairs.where(F.abs("r") > limit).orderBy(F.desc(F.abs("r")), "a", "b").toLocalIterator()):
        if a not in dropped and b not in dropped:
            dropped.append(b if missing.get(b, 0.0) > missing.get(a, 0.0) else a)
    return dropped


def hedges_g(df: DataFrame, columns: list[str], label: str, totals: bool = True) -> DataFrame:
    """column_name, g: |mean difference| in pooled standard deviations, corrected for small samples.

    totals: group sizes are those of the label, as selection uses them; else of each column's known values.
    A pooled deviation of 0 gives 0.
    """
    y = F.col(label) == 1
    wide = []
    for c in columns:
        v = F.col(c).cast("double")
        one, zero = F.when(y, v), F.when(~y, v)
        n1, n0 = (F.count_if(y), F.count_if(~y)) if totals else (F.count(one), F.count(zero))
        pooled = ((n1 - 1) * F.var_samp(one) + (n0 - 1) * F.var_samp(zero)) / (n1 + n0 - 2)
        g = F.abs((F.avg(one) - F.avg(zero)) / F.sqrt(pooled) * (1 - 3 / (4 * (n1 + n0) - 9.0)))
        wide.append(F.when(pooled > 0, g).otherwise(0.0).alias(c))
    return df.agg(*wide).unpivot([], columns, "column_name", "g")


def select_features(effects: DataFrame, g_min: float = 0.25, k_min: int = 10, k_max: int = 100, floor: int = 30) -> DataFrame:
    """Columns with g >= g_min; fewer than k_min: the best `floor`; more than k_max: the best k_max."""
    order = Window.orderBy(F.desc("g"), "column_name")  # a row a column
    ranked = effects.withColumn("place", F.row_number().over(order)).withColumn("strong", F.sum((F.col("g") >= g_min).cast("int")).over(Window.partitionBy(F.lit(0))))
    quota = F.when(F.col("strong") < k_min, floor).otherwise(F.least("strong", F.lit(k_max)))
    return ranked.where(F.col("place") <= quota).select("column_name", "g", F.col("place").cast("long").alias("place"))
