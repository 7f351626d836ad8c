"""Bindings of the driver tables to the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators.ordering import positions

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, every count a long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(r(F.col(f.name).cast("double"), digits).alias(f.name) if kind in ("double", "float") else F.col(f.name).cast("long").alias(f.name) if kind in ("int", "tinyint") else F.col(f.name))
    return df.select(*out)


def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sensor readings: x is null on every seventh id."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))


def placed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """masked_events with the global position, and their number."""
    rows = masked_events(spark, sf_dir)
    return positions(rows, [F.col("ts"), F.col("event_id")]), rows.count()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as a wide sensor frame: nulls by key, a constant, a sparse and a collinear column; fail = returned."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", *NUMERIC,
        F.lit(1.0).alias("constant"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")).alias("sparse"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity") * 2 + 1).alias("collinear"),
        F.when(F.col("l_orderkey") % 211 == 0, F.col("l_quantity")).otherwise(0.0).alias("rare"),
        (F.col("l_returnflag") == "R").cast("int").alias("fail"),
    )


WIDE = [*NUMERIC, "constant", "sparse", "collinear", "rare"]

LINES_SQL = """li AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS constant,
    CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse, CASE WHEN l_orderkey % 7 != 0 THEN l_quantity * 2 + 1 END AS collinear,
    CASE WHEN l_orderkey % 211 = 0 THEN l_quantity ELSE 0.0::DOUBLE END AS rare, (l_returnflag = 'R')::INT AS fail FROM lineitem)"""
LONG_SQL = LINES_SQL + ", lo AS (SELECT fail, l_orderkey, column_name, value FROM (SELECT fail, l_orderkey, unnest([" + ", ".join(f"'{c}'" for c in WIDE) + "]) AS column_name, unnest([" + ", ".join(WIDE) + "]) AS value FROM li))"
EVENTS_SQL = "e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 != 0 THEN value END AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events), n AS (SELECT count(*) AS n FROM events)"


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: p falls with the length, y = toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", (1000.0 / (1000.0 + F.col("n_chars"))).alias("p"), F.col("toxic").cast("int").alias("y"))


SCORED_SQL = "s AS (SELECT doc_id, 1000.0::DOUBLE / (1000.0::DOUBLE + n_chars) AS p, toxic::INT AS y FROM documents JOIN labels USING (doc_id))"
#: Running counts by distinct score, descending.
CURVE_SQL = SCORED_SQL + """, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
    c AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC)),
    k AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / np::DOUBLE AS re FROM c),
    m AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1,
        CASE WHEN (tp + fp)::DOUBLE * np * nn * (nn - fp + np - tp) = 0 THEN 0 ELSE (tp::DOUBLE * (nn - fp) - fp::DOUBLE * (np - tp)) / sqrt((tp + fp)::DOUBLE * np * nn * (nn - fp + np - tp)) END AS mcc FROM k)"""
