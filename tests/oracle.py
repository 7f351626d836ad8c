"""DuckDB beside Spark: rows compared as sorted text, columns by name."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(f'{path}/*.parquet') or [path]!r})")
    return con


def same(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas().convert_dtypes(), views(sf_dir).execute(sql).df().convert_dtypes()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)
