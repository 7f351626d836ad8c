"""Governed extraction: readings with labels, a time range, and the split zones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Time = datetime | str | None


def _time(value: Time) -> Column:
    return F.lit(value).cast("timestamp")


def split_zone(ts: Column, cutoff: Time, exclude_after: Time) -> Column:
    """excluded from exclude_after on; unassigned without a cutoff; cv before it, holdout from it on."""
    return (
        F.when(F.lit(exclude_after is not None) & (ts >= _time(exclude_after)), "excluded")
        .when(F.lit(cutoff is None), "unassigned")
        .when(ts < _time(cutoff), "cv")
        .otherwise("holdout")
    )


def extract(readings: DataFrame, labels: DataFrame, key: str, ts: str, start: Time, end: Time, cutoff: Time = None, exclude_after: Time = None) -> DataFrame:
    """Readings joined with labels by key, start <= ts <= end, with the column split. Not ordered: sort where read."""
    rows = labels.where(F.col(ts).between(_time(start), _time(end)))
    return readings.join(rows, key).withColumn("split", split_zone(F.col(ts), cutoff, exclude_after))


def boundary_collisions(df: DataFrame, ts: str, cutoff: Time, exclude_after: Time) -> DataFrame:
    """Rows exactly on a boundary, which would make the zones ambiguous."""
    return df.where((F.col(ts) == _time(cutoff)) | (F.col(ts) == _time(exclude_after)))


def refuse_collisions(df: DataFrame, ts: str, cutoff: Time, exclude_after: Time) -> DataFrame:
    if not boundary_collisions(df, ts, cutoff, exclude_after).limit(1).isEmpty():
        raise ValueError(f"a row of {ts} stands exactly on a split boundary")
    return df
