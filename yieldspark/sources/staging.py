"""Tables cut from their lineage in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

#: Rows of a summary table (a row a sensor, host or the like) that may be broadcast.
BROADCAST_ROWS = 500_000


def checked(df: DataFrame, name: str) -> DataFrame:
    """A summary table, staged once and hinted for broadcast only if its rows are under BROADCAST_ROWS."""
    from pyspark.sql import functions as F

    table = stage(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
