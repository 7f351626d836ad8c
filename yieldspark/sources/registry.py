"""Column registry, ledgers and snapshots: small governed tables beside the data."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.sources.readers import table_fingerprint

REGISTRY = "column_name string, role string, status string, col_index int, missing_pct double, derived_from string, notes string"


def active_columns(registry: DataFrame) -> list[str]:
    """Features in use, in their order: what a model frame selects."""
    rows = registry.where("role in ('feature_raw', 'feature_eng') and status = 'active'").orderBy(F.col("col_index").asc_nulls_last(), "column_name")
    return [r["column_name"] for r in rows.select("column_name").collect()]


def upsert(registry: DataFrame, rows: DataFrame, key: str = "column_name") -> DataFrame:
    """rows replace those of their key; the others stay; columns are those of the registry."""
    return registry.join(rows.select(key), key, "left_anti").select(*registry.columns).unionByName(rows, allowMissingColumns=True).select(*registry.columns)


def retire(registry: DataFrame, columns: list[str], note: str) -> DataFrame:
    """Status excluded, with the note; never a dropped column."""
    hit = F.col("column_name").isin(*columns)
    return registry.withColumns({"status": F.when(hit, "excluded").otherwise(F.col("status")), "notes": F.when(hit, note).otherwise(F.col("notes"))})


def append_union(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows over the union of the columns."""
    return ledger.unionByName(rows, allowMissingColumns=True)


def append_fixed(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """rows under the ledger's columns: extras are dropped, missing ones null."""
    have = [c for c in ledger.columns if c in rows.columns]
    return ledger.unionByName(rows.select(*have), allowMissingColumns=True)


def write_snapshot(df: DataFrame, path: str, registry: DataFrame, note: str = "") -> dict:
    """matrix and registry as Parquet under path/<id>, a manifest as JSON; the id is the content's hash."""
    spark = df.sparkSession
    print_ = table_fingerprint(df).first().asDict()
    ident = hashlib.md5("|".join(map(str, print_.values())).encode()).hexdigest()[:8]
    manifest = {"snapshot_id": ident, "created": datetime.now(timezone.utc).isoformat(), "note": note, "columns": df.columns} | print_
    df.write.mode("overwrite").parquet(f"{path}/{ident}/matrix")
    registry.write.mode("overwrite").parquet(f"{path}/{ident}/registry")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{ident}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, path: str, ident: str) -> tuple[DataFrame, DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{path}/{ident}/manifest").first()[0])
    return spark.read.parquet(f"{path}/{ident}/matrix"), spark.read.parquet(f"{path}/{ident}/registry"), manifest


def dataset_card(df: DataFrame, label: str) -> DataFrame:
    """One row: n_rows, n_columns, n_fail, fail_rate, columns_md5."""
    y = F.col(label).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_fail"), F.avg(y).alias("fail_rate")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_fail", "fail_rate", F.md5(F.lit("|".join(df.columns)).cast("binary")).alias("columns_md5"))
