"""Run folders, sidecars and the read side of a dashboard, all through Spark's file systems."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Score columns that a queue may carry, the first match counts; artifact names by role.
SCORE_COLUMNS = ("p_cal", "prob_cal", "p_calibrated", "calibrated", "p_hold", "prob", "score", "y_score")
ROLES = {
    "manifest": "files.json",
    "config": "config.json",
    "limits": "spc_limits.csv",
    "screening": "spc_screening.csv",
    "pchart": "pchart_data.csv",
    "protocol_rates": "protocol_rates.csv",
    "protocol_row_missing": "protocol_row_missing.csv",
    "imr_series": "imr_series.csv",
    "scores": "scores.parquet",
    "scorecard": "scorecard.json",
    "reconciliation": "reconciliation.json",
}


def six_digits(df: DataFrame) -> DataFrame:
    """Every double as text of six significant digits, as the CSV artifacts have it (a decimal 5 after them goes up)."""
    return df.select(*(F.format_string("%.6g", F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    six_digits(df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_csv wrote: columns by the header, types by the schema (inferred, if none is given), empty cells null."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """The sidecar's content, or nothing where there is none."""
    try:
        return json.loads(spark.read.text(path).first()[0])
    except Exception as x:
        if "PATH_NOT_FOUND" in str(x):
            return {}
        raise


def write_ordered(df: DataFrame, order: list[str], path: str, rows: int = 2_000_000) -> DataFrame:
    """df as Parquet files under path/data whose names sort in the total order of `order`; returns the manifest.

    Rows are dealt into ranges of about `rows` and sorted in each; nulls come first. The manifest (file, number,
    n, first, last: a row a file) is written beside them. Equal keys may not be told apart between files, so
    `order` should end with a key.
    """
    ranges = max(1, -(-df.count() // rows))
    keys = [F.col(c).asc_nulls_first() for c in order]
    df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/data")
    key = F.struct(*order)
    files = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    files.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """The files of write_ordered, to be read one after the other; raises if they are not all there, whole, or in order."""
    want = spark.read.parquet(f"{path}/manifest").orderBy("number").collect()  # a row a file
    rows = spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    have = {r["file"]: r["n"] for r in rows.collect()}
    if have != {r["file"]: r["n"] for r in want}:
        raise ValueError(f"the files under {path} are not those of its manifest")
    known = spark.createDataFrame([(r["number"], r["first"], r["last"]) for r in want], spark.read.parquet(f"{path}/manifest").select("number", "first", "last").schema)
    before = F.lag("last").over(Window.orderBy("number"))
    if not known.select((before > F.col("first")).alias("wrong")).where("wrong").isEmpty():
        raise ValueError(f"the files under {path} are not in order")
    return [f"{path}/data/{r['file']}" for r in want]


def make_run(spark: SparkSession, root: str, name: str, config: dict, note: str = "", now: datetime | None = None) -> str:
    """A run folder <time>_<name> with its config; returns the run id."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    run = f"{stamp}_{name}"
    write_json(spark, {"run_id": run, "note": note, "config": config}, f"{root}/{run}/config.json")
    return run


def latest_run(index: DataFrame, kind: str) -> str | None:
    """The greatest run id of a type."""
    return index.where(F.col("type") == kind).agg(F.max("run_id")).first()[0]


def artifact_path(spark: SparkSession, folder: str, role: str) -> str:
    """The manifest's file for a role, else the default name."""
    return f"{folder}/{read_json(spark, f"{folder}/{ROLES['manifest']}").get(role, ROLES[role])}"


def batch_summary(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Scorecard and reconciliation of a scored batch; empty where there is none."""
    return {role: read_json(spark, artifact_path(spark, folder, role)) for role in ("scorecard", "reconciliation")}


def require_tables(spark: SparkSession, names: list[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"tables missing: {', '.join(missing)}")


def drift_table(screening: DataFrame, least: float = 0.05) -> DataFrame:
    """Screened sensors that drift: not degenerate, delta known and at least `least`."""
    return screening.where(~F.col("degenerate") & F.col("delta").isNotNull() & (F.col("delta") >= least))


def queue_view(scores: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The first k of a queue with in_top_k: by its rank, or ranked by the first known score column."""
    if "rank" not in scores.columns:
        score = next((c for c in SCORE_COLUMNS if c in scores.columns), None)
        if score is None:
            raise ValueError(f"no rank and none of {', '.join(SCORE_COLUMNS)}")
        top = scores.orderBy(F.desc_nulls_last(score), key).limit(k)
        scores = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), key)).cast("long"))  # k rows
    return scores.where(F.col("rank") <= k).withColumn("in_top_k", F.lit(True))


def legacy_names(df: DataFrame, prefix: str = "s") -> DataFrame:
    """Columns named by number n as s(n + 1), three digits."""
    return df.withColumnsRenamed({c: f"{prefix}{int(c) + 1:03d}" for c in df.columns if c.isdigit()})
