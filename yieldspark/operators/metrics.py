"""Evaluation of scores against binary labels: everything from one running table of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldspark.functions.stats import matthews, ratio
from yieldspark.operators.ordering import column_quantiles, positions, quantile_edges, running_sums
from yieldspark.sources.staging import stage


def threshold_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, positives, negatives, pos, neg for `score >= threshold`, a row a distinct score."""
    y = F.col(label).cast("long")
    scores = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    scores = stage(scores, "scores")  # read three times
    totals = scores.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return running_sums(scores, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}).crossJoin(F.broadcast(totals))


def rates(table: DataFrame) -> DataFrame:
    """The table with precision, recall, f1 and mcc."""
    fn, tn = F.col("positives") - F.col("tp"), F.col("negatives") - F.col("fp")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("positives"))
    out = table.withColumns({"precision": precision, "recall": recall})
    return out.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "mcc": matthews(F.col("tp"), F.col("fp"), fn, tn)})


def average_precision(table: DataFrame) -> DataFrame:
    """Step sum over distinct scores: each score's share of positives times the precision there."""
    return table.agg(F.sum(F.col("pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def roc_auc(table: DataFrame) -> DataFrame:
    """Mann-Whitney with mid-ranks: a negative counts the positives above it and half of its ties."""
    above = F.col("tp") - F.col("pos") + F.col("pos") / 2
    return table.agg((F.sum(F.col("neg") * above) / F.first(F.col("positives").cast("double") * F.col("negatives"))).alias("roc_auc"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """tp, fp, fn, tn at score >= threshold, and precision, recall, f1, mcc, fpr."""
    flag, y = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in {"tp": flag & y, "fp": flag & ~y, "fn": ~flag & y, "tn": ~flag & ~y}.items()))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": matthews(tp, fp, fn, tn), "fpr": fp / F.greatest(fp + tn, F.lit(1))})


def best_threshold(table: DataFrame, criterion: str = "mcc") -> DataFrame:
    """The threshold of the best criterion (mcc or f1); of equals the lowest."""
    best = F.max_by(F.struct("threshold", criterion), F.struct(F.round(criterion, 12), -F.col("threshold")))
    return rates(table).agg(best.alias("b")).select("b.*")


def operating_points(table: DataFrame, targets: list[float]) -> DataFrame:
    """For each recall target the best precision among thresholds that reach it; of equals the lowest threshold."""
    wide = rates(table).withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("recall") >= F.col("target") - 1e-12)
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct(F.round("precision", 12), -F.col("threshold")))
    return wide.groupBy("target").agg(best.alias("b")).select("target", "b.*")


def recall_at_flag_rate(df: DataFrame, score: str, label: str, key: str, rate: float) -> DataFrame:
    """Recall among the k = max(1, floor(n * rate)) highest scores (ties by key)."""
    n, positives = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    k = max(1, int(n * rate))  # a share of all rows: by position, as a limit would take them to one task
    top = positions(df.select(key, score, label), [F.desc(score), F.col(key)], "place__").where(F.col("place__") < k)
    return top.agg(ratio(F.sum(F.col(label).cast("long")), F.lit(positives or 0)).alias("recall"), F.lit(k).cast("long").alias("k"))


def reliability_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, mean_label over quantile bins (linear quantiles); empty bins drop out."""
    edges = quantile_edges(df, [score], [i / bins for i in range(1, bins)]).get(score, [])
    place = sum(((F.col(score) > e).cast("int") for e in edges), F.lit(0))
    return df.where(F.col(score).isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def ranked(df: DataFrame, score: Column, ties: list[Column]) -> DataFrame:
    """df with rank (1 is the highest score; ties in the given order) and decile = (rank - 1) * 10 div n + 1."""
    out = positions(df.withColumn("score__", score), [F.desc("score__"), *ties], "rank")
    n = F.lit(df.count())
    return out.withColumn("decile", F.floor(F.col("rank") * 10 / n).cast("long") + 1).withColumn("rank", F.col("rank") + 1).drop("score__")


def evaluate(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: average precision, ROC-AUC, Brier and the confusion panel at a threshold tuned elsewhere."""
    table = threshold_table(df, score, label)
    parts = [average_precision(table), roc_auc(table), brier(df, score, label), confusion(df, score, label, threshold)]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std, min, q25, q50, q75, max; quantiles are exact and linear."""
    wide = df.agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in columns))
    quarters = column_quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return wide.unpivot([], columns, "column_name", "s").select("column_name", "s.*").join(quarters, "column_name", "left")


def out_of_fold_mean(oof: DataFrame, key: str, p: str = "p_oof") -> DataFrame:
    """Mean prediction of each key over its repeats, and how many there were."""
    return oof.groupBy(key).agg(F.avg(p).alias("p"), F.count(p).alias("n_repeats"))


def rank_invariant(df: DataFrame, raw: str, calibrated: str, label: str, tolerance: float = 1e-9) -> bool:
    """Whether calibration kept the order: equal ROC-AUC before and after."""
    a, b = (roc_auc(threshold_table(df, c, label)).first()[0] for c in (raw, calibrated))
    return a is None and b is None or abs(a - b) <= tolerance
