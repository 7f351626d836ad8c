"""Batch scoring outputs: queues, scorecards, reconciliation, health, drift and the retrain policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldspark.functions.stats import entropy_bits
from yieldspark.operators.metrics import ranked
from yieldspark.operators.ordering import grouped_quantiles, positions, row_ranges
from yieldspark.operators.spc import western_electric
from yieldspark.sources.staging import checked, stage

# Thresholds of health, drift and policy.
HIGH_RISK, TRIAGE_UCL, DRIFT_Z, DRIFT_SHARE, DRIFT_FRACTION, RETRAIN_DELTA = 0.15, 0.20, 3.0, 0.40, 0.25, 0.05


def enforce_contract(df: DataFrame, contract: list[str]) -> DataFrame:
    """The contract's columns in its order, as float; missing ones raise, the first ten named."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} contract columns missing: {', '.join(missing[:10])}")
    return df.select(*(F.col(c).cast("float").alias(c) for c in contract))


def score_queue(scores: DataFrame, key: str, ts: str, raw: str = "score_raw", calibrated: str = "p_cal") -> DataFrame:
    """scores with rank and decile by the calibrated score, else the raw one; ties by time, then key."""
    return ranked(scores, F.coalesce(F.col(calibrated), F.col(raw)), [F.col(ts), F.col(key)])


def inspection_queue(queue: DataFrame, k: int) -> DataFrame:
    """The k first ranks: a filter, not a sort."""
    return queue.where(F.col("rank") <= k).withColumn("in_top_k", F.lit(True))


def scorecard(queue: DataFrame, p: str, fail: str, flag: str, keys: list[str] | None = None) -> DataFrame:
    """Panel of a scored batch (or of each group of keys): p quantiles, top-decile fails, capture, lift, enrichment.

    fail may be null (unlabelled counts as not failed); without any label or fail capture and lift are null;
    enrichment compares the flag's share in the top decile with the batch, null where that is 0.
    """
    top = F.col("decile") == 1
    y = F.coalesce(F.col(fail).cast("int"), F.lit(0))
    keys = keys or []
    queue = stage(queue, "queue")  # read twice
    quantiles = grouped_quantiles(queue, keys, p, {"p_median": 0.5, "p90": 0.9})
    out = queue.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_mean"),
        F.count(fail).alias("n_labelled"), F.sum(y).alias("n_fail"), F.count_if(top).alias("n_top"), F.sum(F.when(top, y)).alias("top_fails"),
        F.avg(F.col(flag).cast("double")).alias("flag_share"), F.avg(F.when(top, F.col(flag).cast("double"))).alias("top_flag_share"),
    )
    out = out.join(quantiles, keys, "left") if keys else out.crossJoin(F.broadcast(quantiles))
    known = (F.col("n_labelled") > 0) & (F.col("n_fail") > 0)
    return out.withColumns(
        {
            "capture": F.when(known, F.col("top_fails") / F.col("n_fail")),
            "lift": F.when(known, (F.col("top_fails") / F.col("n_top")) / (F.col("n_fail") / F.col("n"))),
            "enrichment": F.when(F.col("flag_share") > 0, F.col("top_flag_share") / F.col("flag_share")),
        }
    )


def scorecard_delta(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Differences in p_median, p_mean, p90 and capture from a one-row reference panel."""
    names = ("p_median", "p_mean", "p90", "capture")
    ref = reference.select(*(F.col(c).alias(f"ref_{c}") for c in names))
    return panel.crossJoin(F.broadcast(ref)).select("*", *((F.col(c) - F.col(f"ref_{c}")).alias(f"d_{c}") for c in names)).drop(*(f"ref_{c}" for c in names))


def reconcile_keyed(scores: DataFrame, reference: DataFrame, key: str, score: str, ref_score: str, tolerance: float = 1e-6) -> DataFrame:
    """n, n_reference, n_matched, max_abs_diff and the verdict: pass, fail_values or fail_key_coverage."""
    both = scores.select(key, F.col(score).alias("a")).join(reference.select(key, F.col(ref_score).alias("b")), key)
    stats = both.agg(F.count(F.lit(1)).alias("n_matched"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
    sizes = scores.agg(F.count(F.lit(1)).alias("n")).crossJoin(reference.agg(F.count(F.lit(1)).alias("n_reference")))
    verdict = F.when((F.col("n_matched") != F.col("n")) | (F.col("n") != F.col("n_reference")), "fail_key_coverage").when(F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) < tolerance, "pass").otherwise("fail_values")
    return sizes.crossJoin(stats).withColumn("verdict", verdict)


def reconcile_sorted(scores: DataFrame, reference: DataFrame, score: str, ref_score: str, tolerance: float = 1e-6) -> DataFrame:
    """The same without keys: values compared in sorted order; pass_values_only, fail_values or fail_length."""

    a = positions(scores.select(F.col(score).alias("a")), [F.col("a")])
    b = positions(reference.select(F.col(ref_score).alias("b")), [F.col("b")])
    both = a.join(b, "pos", "full_outer")
    out = both.agg(F.count("a").alias("n"), F.count("b").alias("n_reference"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
    verdict = F.when(F.col("n") != F.col("n_reference"), "fail_length").when(F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) < tolerance, "pass_values_only").otherwise("fail_values")
    return out.withColumn("verdict", verdict)


def reconcile(scores: DataFrame, reference: DataFrame, score: str, ref_score: str, key: str | None = None, order: str | None = None, ref_order: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row with a verdict: by key where the reference has it, else by position, else by sorted values.

    Positions are those of `order` and `ref_order`. Equal there is pass, equal only when sorted is
    pass_values_only; fail_length and fail_values say what differs.
    """
    if key is not None and key in reference.columns:
        return reconcile_keyed(scores, reference, key, score, ref_score, tolerance)
    place = lambda df, by, c, n: positions(df.select(F.col(by).alias("by__"), F.col(c).alias(n)), [F.col("by__")]).drop("by__")
    both = place(scores, order, score, "a").join(place(reference, ref_order, ref_score, "b"), "pos", "full_outer")
    placed = both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("positional_max_abs_diff"))
    ranked_ = reconcile_sorted(scores, reference, score, ref_score, tolerance).withColumnRenamed("max_abs_diff", "sorted_max_abs_diff")
    same = F.coalesce(F.col("positional_max_abs_diff"), F.lit(0.0)) < tolerance
    out = ranked_.crossJoin(placed).withColumn("verdict", F.when((F.col("verdict") != "fail_length") & same, "pass").otherwise(F.col("verdict")))
    return out.select("n", "n_reference", "positional_max_abs_diff", "sorted_max_abs_diff", "verdict")


def output_health(scores: DataFrame, p: Column, keys: list[str] | None = None, high_risk: float = HIGH_RISK, triage_ucl: float = TRIAGE_UCL) -> DataFrame:
    """mean, population std, triage rate (p >= high_risk), mean entropy in bits, n; risk_ooc by the unrounded rate."""
    rows = scores.withColumn("p__", p).where("p__ is not null")
    out = rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p__").alias("m"), F.stddev_pop("p__").alias("s"), F.avg((F.col("p__") >= high_risk).cast("double")).alias("t"), F.avg(entropy_bits(F.col("p__"))).alias("e")
    )
    return out.select(*(keys or []), "n", *(F.round(c, 4).alias(n) for c, n in (("m", "mean_risk"), ("s", "std_risk"), ("t", "triage_rate"), ("e", "mean_entropy"))), (F.col("t") >= triage_ucl).alias("risk_ooc"))


def feature_drift(rows: DataFrame, limits: DataFrame, sensor: str, value: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per (keys, sensor): max |z|, share beyond 2 sigma, rule 1, drifted. Nulls leave; degenerate limits are skipped."""
    keys = keys or []
    seen = rows.where(F.col(value).isNotNull()).join(checked(limits.where("not degenerate and sigma > 0").select(sensor, "center", "sigma"), "limits"), sensor)
    z = (F.col(value) - F.col("center")) / F.col("sigma")
    ruled = western_electric(seen.withColumn("zz", z), [*keys, sensor], order, z, row_ranges(rows))
    out = ruled.groupBy(*keys, sensor).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("zz")).alias("max_z"), F.avg((F.abs("zz") > 2).cast("double")).alias("beyond_2s"), F.max("r1").alias("any_r1"))
    return out.withColumn("drifted", F.col("any_r1") | (F.col("max_z") > DRIFT_Z) | (F.col("beyond_2s") >= DRIFT_SHARE)).withColumn("max_z", F.round("max_z", 2))


def monitor_verdict(health: DataFrame, drift: DataFrame, keys: list[str]) -> DataFrame:
    """Per batch: n_features, drift_fraction, and RETRAIN (risk), INVESTIGATE (drift) or IN_CONTROL."""
    share = drift.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"), F.avg(F.col("drifted").cast("double")).alias("drift_fraction"))
    out = health.join(share, keys, "left").fillna({"n_features": 0, "drift_fraction": 0.0})
    return out.withColumn("verdict", F.when(F.col("risk_ooc"), "RETRAIN").when(F.col("drift_fraction") >= DRIFT_FRACTION, "INVESTIGATE").otherwise("IN_CONTROL"))


def retrain_policy(ledger: DataFrame, order: str, consecutive: int = 1, threshold: float = RETRAIN_DELTA) -> DataFrame:
    """One row: action, metric, n_records, evidence (the order values looked at, newest first).

    The metric is max_delta where the ledger has that column, else drift_fraction; rows without a number in it
    are left out. RETRAIN_RECOMMENDED if the last `consecutive` are all at the threshold, or one of them says
    RETRAIN or RETRAIN_RECOMMENDED in `verdict`; else IN_CONTROL. NO_METRICS and NO_VALID_RECORDS say why not.
    """
    spark = ledger.sparkSession
    metric = next((m for m in ("max_delta", "drift_fraction") if m in ledger.columns), None)
    kind = "action string, metric string, n_records long, evidence array<string>"
    if metric is None:
        return spark.createDataFrame([("NO_METRICS", None, 0, [])], kind)
    said = F.col("verdict") if "verdict" in ledger.columns else F.lit(None).cast("string")
    value = F.col(metric).cast("string").try_cast("double")
    rows = ledger.select(F.col(order).cast("string").alias("id"), value.alias("v"), said.alias("said")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    last = rows.orderBy(F.desc("id")).limit(consecutive)
    out = last.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max(F.coalesce(F.col("said").isin("RETRAIN", "RETRAIN_RECOMMENDED"), F.lit(False))).alias("told"), F.sort_array(F.collect_list("id"), asc=False).alias("evidence"))
    action = F.when(F.col("n") == 0, "NO_VALID_RECORDS").when(F.col("told") | ((F.col("n") >= consecutive) & (F.col("least") >= threshold)), "RETRAIN_RECOMMENDED").otherwise("IN_CONTROL")
    return out.select(action.alias("action"), F.lit(metric).alias("metric"), F.col("n").alias("n_records"), "evidence")


def retrain_decision(spark: SparkSession, path: str, order: str = "run_id", consecutive: int = 1, threshold: float = RETRAIN_DELTA) -> dict:
    """retrain_policy over a ledger CSV, as a record with retrain_recommended and exit_code (1 to retrain, else 0).

    NO_DATA where there is no file, EMPTY where it has no column or row, ERROR where it cannot be read.
    """
    empty = {"verdict": "EMPTY", "metric": None, "n_records": 0, "evidence": []}
    try:
        ledger = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
        if not ledger.columns or ledger.isEmpty():
            found = empty
        else:
            row = retrain_policy(ledger, order, consecutive, threshold).first()
            found = {"verdict": row["action"], "metric": row["metric"], "n_records": row["n_records"], "evidence": row["evidence"]}
    except Exception as x:  # the verdict says so, as the policy must not stop a schedule
        found = empty | ({"verdict": "NO_DATA"} if "PATH_NOT_FOUND" in str(x) else {"verdict": "ERROR", "reason": str(x).splitlines()[0]})
    hit = found["verdict"] == "RETRAIN_RECOMMENDED"
    return found | {"threshold": threshold, "consecutive": consecutive, "retrain_recommended": hit, "exit_code": int(hit)}


def resolve_bundle(ledger: DataFrame, calibrated: bool = True) -> DataFrame:
    """The latest training run (empty type) and the latest calibration run whose parent it is (null if none)."""
    train = ledger.where("coalesce(type, '') = ''").agg(F.max("run_id").alias("train_id"))
    cal = ledger.where("type = 'calibrate'").select(F.col("run_id").alias("cal_id"), "parent_run")
    out = train.join(cal, F.col("train_id") == F.col("parent_run"), "left").groupBy("train_id").agg(F.max("cal_id").alias("calibrator_id"))
    return out if calibrated else out.withColumn("calibrator_id", F.lit(None).cast("string"))


