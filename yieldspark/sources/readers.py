"""Sources: separated text, named-parameter SQL, bootstrap lots, and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldspark.functions.nulls import to_number


def read_separated(spark: SparkSession, path: str, columns: int, prefix: str = "s") -> DataFrame:
    """Headerless rows of white-space separated numbers as <prefix>001..; NaN and what does not parse are null.

    Adds line (0-based, dense in each file's byte order) and n_fields, for the shape gate.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # ids are dense in each block; blocks (one row each) are offset by the rows before them
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = lines.join(F.broadcast(offsets), ["file", "block"]).withColumn("line", F.col("at") - F.col("first") + F.col("offset"))
    parts = F.split(F.trim("value"), r"\s+")
    fields = [to_number(F.get(parts, k)).alias(f"{prefix}{k + 1:03d}") for k in range(columns)]
    return numbered.select("line", F.size(parts).alias("n_fields"), *fields)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows `label "dd/MM/yyyy HH:mm:ss"`: target, timestamp (null where it does not parse)."""
    part = F.regexp_extract_all("value", F.lit(r'^\s*(-?\d+)\s+"?([^"]*)"?\s*$'), F.lit(1))
    stamp = F.regexp_extract("value", r'^\s*-?\d+\s+"?([^"]*)"?\s*$', 1)
    return spark.read.text(path).select(F.get(part, 0).cast("int").alias("target"), F.try_to_timestamp(stamp, F.lit("dd/MM/yyyy HH:mm:ss")).alias("timestamp"))


def shape_gate(readings: DataFrame, labels: DataFrame, rows: int, columns: int) -> None:
    """All of rows, fields and timestamps as expected, or one error that names every violation."""
    r = readings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_fields") != columns).alias("bad")).first()
    lab = labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp").isNull()).alias("bad")).first()
    found = [m for bad, m in ((r["n"] != rows, f"{r['n']} readings, not {rows}"), (r["bad"], f"{r['bad']} rows without {columns} fields"), (lab["n"] != rows, f"{lab['n']} labels, not {rows}"), (lab["bad"], f"{lab['bad']} unparseable timestamps")) if bad]
    if found:
        raise ValueError("; ".join(found))


def run_query(spark: SparkSession, text: str, **params: object) -> DataFrame:
    """SQL text with :named parameters."""
    return spark.sql(text, args=params)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file, read in pieces: memory does not grow with a file.

    Files are read as runs of bytes up to each line end, which go to one task a file in their order and are
    hashed as they come. A file may have any size and content; a run without a line end must be under 2 GB.
    Files of no bytes are left out, as Spark's readers do not list them.
    """
    runs = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("run"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, seen, digest = None, 0, 0, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])

        for b in batches:
            for file, whole, run in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), b.column("run").to_pylist(), strict=True):
                if file != now:
                    if now is not None:
                        yield row()
                    now, size, seen, digest = file, whole, 0, hashlib.sha256()
                digest.update(run)
                seen += len(run)
                if seen < size:  # the last run has a line end only if the file ends with one
                    digest.update(b"\n")
                    seen += 1
        if now is not None:
            yield row()

    return runs.repartition("path").sortWithinPartitions("path", "block", "at").select("path", "size", "run").mapInArrow(hashed, "path string, bytes long, sha256 string")


def data_fingerprint(log: DataFrame, sql: str, order: str = "ingest_id", files: int = 2) -> DataFrame:
    """raw (source_file: hash, of the last `files` rows of an ingestion log) and extract_sql_sha256, one row.

    log has source_file, source_sha256 and the order column; of two rows of one file the later counts. An
    empty log gives an empty map.
    """
    last = log.orderBy(F.desc(order)).limit(files)  # a few rows
    newest = last.groupBy("source_file").agg(F.max_by("source_sha256", order).alias("hash"))
    pairs = F.array_sort(F.collect_list(F.struct("source_file", "hash")))
    return newest.agg(F.map_from_entries(pairs).alias("raw"), F.sha2(F.lit(sql.encode()), 256).alias("extract_sql_sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, columns_md5 and an order-free content hash: equal for equal rows in any order or partitioning.

    A row is the md5 of its values as text, each led by a mark (nulls have another); its first 52 bits add up
    in content_sum, the next 52 are combined in content_xor. Arrays, maps and structs count as JSON.
    """
    cells = [F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f.name).cast("string") for f in df.schema.fields]
    row = F.md5(F.concat(*(F.coalesce(F.concat(F.lit("|"), c), F.lit("~")) for c in cells)).cast("binary"))
    part = lambda k: F.conv(F.substring(row, 13 * k + 1, 13), 16, 10).cast("long")
    total = F.coalesce(F.sum(part(0).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("content_sum"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("content_xor")).withColumn("columns_md5", F.md5(F.lit("|".join(df.columns)).cast("binary")))
