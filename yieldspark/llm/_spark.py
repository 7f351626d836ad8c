"""Small Spark helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes batches and shards, so that one holds a fixed amount at any scale."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def row_of(docs: DataFrame) -> tuple[Column, str]:
    """All columns as one struct `row`, and its type: carried through an operator, no name can clash."""
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return row, docs.select(row).schema["row"].dataType.simpleString()
