import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.operators import metrics, models, monitoring, ordering


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.25).astype(int)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "k long, p double, y int"), p, y


def test_curve_metrics(scored):
    df, p, y = scored
    t = metrics.threshold_table(df, "p", "y")
    ap, last = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        hit = p >= s
        recall = y[hit].sum() / y.sum()
        ap, last = ap + (recall - last) * y[hit].mean(), recall
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert metrics.average_precision(t).first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(t).first()[0] == pytest.approx(auc)


def test_running_sums_over_ranges(scored):
    df, p, y = scored
    from yieldspark.operators.ordering import positions

    got = [r["pos"] for r in positions(df, [F.desc("p"), F.col("k")], ranges=5).orderBy(F.desc("p"), "k").collect()]
    assert got == list(range(400))


def test_separable_is_perfect(spark):
    rows = spark.createDataFrame([(i, 0.9 if i < 10 else 0.1, int(i < 10)) for i in range(100)], "k long, p double, y int")
    t = metrics.threshold_table(rows, "p", "y")
    assert metrics.average_precision(t).first()[0] == 1 and metrics.roc_auc(t).first()[0] == 1
    assert metrics.recall_at_flag_rate(rows, "p", "y", "k", 0.1).first().asDict() == {"recall": 1.0, "k": 10}
    assert metrics.best_threshold(t).first()["threshold"] == 0.9


def test_confusion_golden(spark):
    rows = [(0.9, 1)] * 22 + [(0.9, 0)] * 43 + [(0.1, 1)] * 68 + [(0.1, 0)] * 1176
    got = metrics.confusion(spark.createDataFrame(rows, "p double, y int"), "p", "y", 0.5).first()
    assert [round(got[c], 4) for c in ("precision", "recall", "f1", "mcc", "fpr")] == [0.3385, 0.2444, 0.2839, 0.2436, 0.0353]


def test_rank_decile_ties(spark):
    rows = spark.createDataFrame([(i, 0.5) for i in range(15)], "k long, p double")
    got = metrics.ranked(rows, F.col("p"), [F.col("k")]).orderBy("rank").collect()
    assert [r["k"] for r in got] == list(range(15))
    assert [r["decile"] for r in got] == [i * 10 // 15 + 1 for i in range(15)]


def test_scorecard_by_hand(spark):
    p = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
    rows = spark.createDataFrame([(i + 1, v, None, i, int(i + 1 in (1, 2)), int(i == 0)) for i, v in enumerate(p)], "wafer_id long, score_raw double, p_cal double, ts long, fail int, flag int")
    queue = monitoring.score_queue(rows, "wafer_id", "ts").withColumn("p", F.coalesce("p_cal", "score_raw"))
    got = monitoring.scorecard(queue, "p", "fail", "flag").first()
    assert (got["top_fails"], got["capture"], got["lift"], got["enrichment"]) == (1, 0.5, 5.0, 10.0)
    none = monitoring.scorecard(queue.withColumn("fail", F.lit(None).cast("int")), "p", "fail", "flag").first()
    assert none["capture"] is None and none["lift"] is None


def test_contract(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "b double, a double, c double")
    assert monitoring.enforce_contract(df, ["a", "b"]).dtypes == [("a", "float"), ("b", "float")]
    with pytest.raises(ValueError, match="x0, x1"):
        monitoring.enforce_contract(df, [f"x{i}" for i in range(20)])


@pytest.mark.parametrize(
    "ledger, kind, k, action",
    [
        ([("1", 0.06)], "run_id string, max_delta double", 1, "RETRAIN_RECOMMENDED"),
        ([("1", 0.06), ("2", 0.01)], "run_id string, max_delta double", 1, "IN_CONTROL"),
        ([("1", 0.06)], "run_id string, max_delta double", 2, "IN_CONTROL"),
        ([("1", 0.06), ("2", 0.07)], "run_id string, drift_fraction double", 2, "RETRAIN_RECOMMENDED"),
        ([("1", None)], "run_id string, max_delta double", 1, "NO_VALID_RECORDS"),
        ([], "run_id string, max_delta double", 1, "NO_VALID_RECORDS"),
        ([("1", "x")], "run_id string, note string", 1, "NO_METRICS"),
        ([("1", 0.0, "RETRAIN")], "run_id string, drift_fraction double, verdict string", 1, "RETRAIN_RECOMMENDED"),
        ([("1", None, 0.0, "RETRAIN"), ("0", 0.01, None, None)], "run_id string, max_delta double, drift_fraction double, verdict string", 1, "IN_CONTROL"),
    ],
)
def test_retrain_policy(spark, ledger, kind, k, action):
    assert monitoring.retrain_policy(spark.createDataFrame(ledger, kind), "run_id", k).first()["action"] == action


def test_health_and_reconcile(spark):
    rows = spark.createDataFrame([(i, 0.9 if i < 35 else 0.01) for i in range(100)], "k long, p double")
    got = monitoring.output_health(rows, F.col("p")).first()
    assert got["triage_rate"] == 0.35 and got["risk_ooc"]
    other = rows.withColumn("p", F.col("p") + 1e-8)
    assert monitoring.reconcile_keyed(rows, other, "k", "p", "p").first()["verdict"] == "pass"
    assert monitoring.reconcile_keyed(rows, other.where("k > 3"), "k", "p", "p").first()["verdict"] == "fail_key_coverage"
    assert monitoring.reconcile_sorted(rows, other, "p", "p").first()["verdict"] == "pass_values_only"
    assert monitoring.reconcile_sorted(rows, other.where("k > 3"), "p", "p").first()["verdict"] == "fail_length"


def test_folds_and_calibration(spark, scored):
    df, p, y = scored
    folds = models.stratified_folds(df, "k", "y", 5, 2)
    assert folds.count() == 800 and folds.groupBy("repeat", "k").count().where("count != 1").isEmpty()
    sizes = [r["n"] for r in folds.groupBy("repeat", "fold", "y").agg(F.count("*").alias("n")).where("y = 1").collect()]
    assert max(sizes) - min(sizes) <= 1
    cal = models.apply_platt(models.platt(df, "p", "y"), df)
    auc = lambda d, c: metrics.roc_auc(metrics.threshold_table(d, c, "y")).first()[0]
    assert auc(cal, "p_cal") == pytest.approx(auc(df, "p"))
    raw, after = (metrics.brier(cal, c, "y").first()[0] for c in ("p", "p_cal"))
    assert after < raw
    iso = models.isotonic(df, "p", "y").transform(df).orderBy("p").toPandas()["p_cal"].to_numpy()
    assert (np.diff(iso) >= 0).all()


def test_folds_and_flag_rate_in_ranges(spark, scored, monkeypatch):
    """Many ordered ranges give what one gives, null classes too."""
    df = scored[0]
    labelled = df.select("k", F.when(F.col("k") % 11 != 0, F.col("y")).alias("y"))

    def every():
        folds = {tuple(r) for r in models.stratified_folds(labelled, "k", "y", 5, 2).select("repeat", "k", "y", "fold").collect()}
        return folds, metrics.recall_at_flag_rate(df, "p", "y", "k", 0.2).first()

    whole = every()
    monkeypatch.setattr(ordering, "RANGE_ROWS", 60)
    assert every() == whole and len(whole[0]) == 800
