"""Missingness features, shares and drift."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_null(columns: list[str]) -> Column:
    """1 if any of the columns is null, else 0 (byte)."""
    return reduce(or_, (F.col(c).isNull() for c in columns)).cast("byte")


def missing_rate(columns: list[str]) -> Column:
    """Share of the columns that are null, in one expression of logarithmic depth."""
    terms = [F.col(c).isNull().cast("int") for c in columns]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0] / F.lit(float(len(columns)))


def missingness_features(df: DataFrame, groups: dict[str, list[str]], sensors: list[str], rate: str = "f_row_missing_rate") -> DataFrame:
    """df with an any-null flag for each named group and the row's missing rate over all sensors (float)."""
    return df.withColumns({name: any_null(columns) for name, columns in groups.items()} | {rate: missing_rate(sensors).cast("float")})


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing_pct: one pass, one wide aggregate, then a row a column."""
    wide = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot([], columns, "column_name", "missing_pct")


def missing_drift(now: DataFrame, frozen: DataFrame, limit: float = 0.02) -> DataFrame:
    """Shares now against frozen ones: delta, and flagged where it is over the limit (strictly)."""
    old = frozen.select("column_name", F.col("missing_pct").alias("frozen_pct"))
    out = now.join(old, "column_name", "left").withColumn("delta", F.col("missing_pct") - F.col("frozen_pct"))
    return out.withColumn("flagged", F.coalesce(F.abs("delta") > limit, F.lit(False)))


def schema_violations(df: DataFrame, required: dict[str, str], sensors: list[str]) -> list[str]:
    """All violations at once: missing columns, wrong types, null or repeated keys (the first required column)."""
    types = dict(df.dtypes)
    found = [f"{c}: missing" for c in required if c not in types]
    found += [f"{c}: {types[c]}, not {t}" for c, t in required.items() if c in types and types[c] != t]
    found += [f"{c}: {types.get(c)}, not double" for c in sensors if types.get(c) != "double"]
    key = next(iter(required))
    if key in types:
        n, known, distinct = df.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
        found += [f"{key}: {n - known} null"] * (n > known) + [f"{key}: {known - distinct} repeated"] * (known > distinct)
    return found


def recode_target(df: DataFrame, target: str = "target", name: str = "is_fail") -> DataFrame:
    """is_fail = (target = 1); if the column is there already, it must agree."""
    flag = (F.col(target) == 1).cast("byte")
    if name in df.columns and not df.where(~F.col(name).eqNullSafe(flag)).limit(1).isEmpty():
        raise ValueError(f"{name} contradicts {target}")
    return df.withColumn(name, flag)
