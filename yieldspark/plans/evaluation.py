"""Metric, fold and calibration queries over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.functions.draws import uniform_sql
from yieldspark.operators import doe, metrics, models
from yieldspark.plans.tables import CURVE_SQL, SCORED_SQL, r, rounded, scored_documents, table

TARGETS = [0.5, 0.6, 0.7]


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_table(scored_documents(spark, sf_dir), "p", "y")


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rates(_curve(spark, sf_dir)).select("threshold", "tp", "fp", "precision", "recall", "f1", "mcc"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_curve(spark, sf_dir)))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_curve(spark, sf_dir)))


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.brier(scored_documents(spark, sf_dir), "p", "y"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(scored_documents(spark, sf_dir), "p", "y", 0.5))


def mcc_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(_curve(spark, sf_dir), "mcc"))


def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(_curve(spark, sf_dir), "f1"))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.operating_points(_curve(spark, sf_dir), TARGETS))


def recall_at_flagrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recall_at_flag_rate(scored_documents(spark, sf_dir), "p", "y", "doc_id", 0.05))


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability_bins(scored_documents(spark, sf_dir), "p", "y"))


def evaluate_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.evaluate(scored_documents(spark, sf_dir), "p", "y", 0.5).select("average_precision", "roc_auc", "brier", "tp", "fp", "fn", "tn"))


def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.describe(table(spark, sf_dir, "orders"), ["o_totalprice"]), 4)


def oof_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = models.stratified_folds(table(spark, sf_dir, "labels"), "doc_id", "toxic", 5, 3)
    oof = folds.join(scored_documents(spark, sf_dir), "doc_id").withColumn("p_oof", F.col("p") + F.col("fold") / 10)
    return rounded(metrics.out_of_fold_mean(oof, "doc_id"))


def noisy_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's response under both kinds of noise."""
    p, key = F.col("p"), F.col("doc_id")
    return rounded(scored_documents(spark, sf_dir).select("doc_id", doe.with_noise(p, "bernoulli", key, seed=3).alias("b"), doe.with_noise(p, "logit-gaussian", key, 0.1, 3).alias("g")))


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), "doc_id", "toxic", 5, 3))


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier by repeat and overall, mean and deviation over folds, by grouping sets."""
    folds = models.stratified_folds(table(spark, sf_dir, "labels"), "doc_id", "toxic", 5, 3)
    cells = folds.join(scored_documents(spark, sf_dir).select("doc_id", "p", "y"), "doc_id").groupBy("repeat", "fold").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("b"))
    out = cells.groupingSets([["repeat"], []], "repeat").agg(F.avg("b").alias("mean"), F.stddev_samp("b").alias("std"), F.count("b").alias("n"))
    return rounded(out.select(F.coalesce("repeat", F.lit(0)).alias("repeat"), "mean", "std", "n"))


def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir)
    return models.apply_platt(models.platt(rows, "p", "y"), rows).select("doc_id", r("p", 9).alias("p"), r("p_cal", 4).alias("p_cal"))


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir)
    return models.isotonic(rows, "p", "y").transform(rows).select("doc_id", r("p", 9).alias("p"), r("p_cal", 6).alias("p_cal"))


QUERIES = {f.__name__: f for f in (pr_curve, average_precision, roc_auc, brier, confusion, mcc_threshold, f1_threshold, operating_points, recall_at_flagrate, reliability_bins, evaluate_bundle, describe_columns, oof_mean, noisy_response, stratified_folds, fold_metrics, platt_calibration, isotonic_calibration)}

FOLDS_SQL = "f AS (SELECT t.r AS repeat, doc_id, toxic::BIGINT AS toxic, ((row_number() OVER (PARTITION BY t.r, toxic ORDER BY md5(t.r::VARCHAR || '|1337|' || doc_id::VARCHAR), doc_id) - 1) % 5)::BIGINT AS fold FROM labels, range(1, 4) t(r))"
ORACLE_SQL = {
    # Newton steps on the penalised likelihood; b is the score's weight, of which half the square is added
    "platt_calibration": f"""WITH RECURSIVE {SCORED_SQL}, g AS (SELECT p AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM s GROUP BY 1),
        it AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT step + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
            FROM (SELECT step, a, b, sum(n * q - k) AS g0, sum((n * q - k) * x) + b AS g1, sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q) * x * x) + 1 AS h11
                FROM (SELECT step, a, b, x, n, k, 1 / (1 + exp(-(a + b * x))) AS q FROM it, g WHERE step < 30) GROUP BY step, a, b))
        SELECT doc_id, round(p, 9) AS p, round(1 / (1 + exp(-(a + b * p))), 4) AS p_cal FROM s, it WHERE step = 30""",
    # the greatest of the least means of runs from and to a score: the isotonic fit
    "isotonic_calibration": f"""WITH {SCORED_SQL}, g AS (SELECT p, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM s GROUP BY p), i AS (SELECT p, y, n, row_number() OVER w AS k, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p)),
        ab AS (SELECT a.k AS a, b.k AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM i a JOIN i b ON b.k >= a.k), mi AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM ab), f AS (SELECT b AS k, max(m) AS fit FROM mi WHERE a <= b GROUP BY b)
        SELECT doc_id, round(s.p, 9) AS p, round(fit, 6) + 0.0 AS p_cal FROM s JOIN i USING (p) JOIN f USING (k)""",
    "pr_curve": f"WITH {CURVE_SQL} SELECT round(p, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) + 0.0 AS mcc FROM m",
    "average_precision": f"WITH {CURVE_SQL} SELECT round(sum(pos / np::DOUBLE * tp / (tp + fp)), 6) AS average_precision FROM c",
    "roc_auc": f"WITH {CURVE_SQL} SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(np::DOUBLE * nn), 6) AS roc_auc FROM c",
    "brier": f"WITH {SCORED_SQL} SELECT round(avg((p - y) ** 2), 6) AS brier FROM s",
    "confusion": f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s)
        SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc, round(fp / (fp + tn)::DOUBLE, 6) AS fpr FROM c""",
    "mcc_threshold": f"WITH {CURVE_SQL} SELECT round(p, 6) AS threshold, round(mcc, 6) + 0.0 AS mcc FROM m ORDER BY round(mcc, 12) DESC, p LIMIT 1",
    "f1_threshold": f"WITH {CURVE_SQL} SELECT round(p, 6) AS threshold, round(f1, 6) AS f1 FROM m ORDER BY round(f1, 12) DESC, p LIMIT 1",
    "operating_points": f"""WITH {CURVE_SQL}, o AS (SELECT t.target::DOUBLE AS target, m.*, row_number() OVER (PARTITION BY t.target ORDER BY round(pr, 12) DESC, p) AS rn FROM m, (SELECT unnest({TARGETS}) AS target) t WHERE re >= t.target - 1e-12)
        SELECT target, round(p, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall FROM o WHERE rn = 1""",
    "recall_at_flagrate": f"WITH {SCORED_SQL}, k AS (SELECT greatest(1, floor(count(*) * 0.05::DOUBLE))::BIGINT AS k, sum(y) AS np FROM s), o AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS rn FROM s) SELECT round(sum(y) / max(np)::DOUBLE, 6) AS recall, max(k) AS k FROM o, k WHERE rn <= k",
    "reliability_bins": f"""WITH {SCORED_SQL}, e AS (SELECT quantile_cont(p, [{', '.join(f'{i}::DOUBLE / 10' for i in range(1, 10))}]) AS e FROM s), b AS (SELECT p, y, len(list_filter(e, lambda x: p > x))::BIGINT AS bin FROM s, e)
        SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS mean_label FROM b GROUP BY 1""",
    "stratified_folds": f"WITH {FOLDS_SQL} SELECT * FROM f",
    "fold_metrics": f"WITH {FOLDS_SQL}, {SCORED_SQL}, c AS (SELECT repeat, fold, avg((p - y) ** 2) AS b FROM f JOIN s USING (doc_id) GROUP BY ALL) SELECT coalesce(repeat, 0)::BIGINT AS repeat, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, count(*) AS n FROM c GROUP BY GROUPING SETS ((repeat), ())",
    "evaluate_bundle": f"WITH {CURVE_SQL}, a AS (SELECT sum(pos / np::DOUBLE * tp / (tp + fp)) AS ap, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(np::DOUBLE * nn) AS auc FROM c), b AS (SELECT avg((p - y) ** 2) AS b, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM s) SELECT round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round(b, 6) AS brier, tp, fp, fn, tn FROM a, b",
    "describe_columns": "SELECT 'o_totalprice' AS column_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(max(o_totalprice), 4) AS max FROM orders",
    "oof_mean": f"WITH {FOLDS_SQL}, {SCORED_SQL} SELECT doc_id, round(avg(p + fold / 10.0::DOUBLE), 6) AS p, count(*) AS n_repeats FROM f JOIN s USING (doc_id) GROUP BY 1",
    "noisy_response": f"""WITH {SCORED_SQL}, u AS (SELECT doc_id, p, greatest(least(p, 1 - 1e-6), 1e-6) AS c, {uniform_sql('doc_id', 3)} AS u, {uniform_sql('doc_id', 3, 1)} AS v FROM s)
        SELECT doc_id, (u < p)::INT::DOUBLE AS b, round(1 / (1 + exp(-(ln(c / (1 - c)) + 0.1 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)))), 6) AS g FROM u""",
}
