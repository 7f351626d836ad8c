"""Extraction, features, quality and registry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import extract, features, monitoring, quality
from yieldspark.operators.ordering import positions
from yieldspark.plans.tables import LINES_SQL, LONG_SQL, WIDE, lines, rounded, table
from yieldspark.sources import artifacts, readers, registry
from yieldspark.sources.committed import Conflict, Store, retire
from yieldspark.sources.staging import folder

CUTOFF, EXCLUDE = "1999-01-01 00:00:00", "2000-06-01 00:00:00"


def extract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    rows = extract.extract(readings, orders, "o_custkey", "o_orderdate", "1996-01-01", "2000-12-31", CUTOFF, EXCLUDE)
    return rounded(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("first")))


def boundary_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.boundary_collisions(table(spark, sf_dir, "orders"), "o_orderdate", CUTOFF, EXCLUDE).select("o_orderkey", "o_orderdate")


def any_null_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"f_pair": ["sparse", "collinear"], "f_base": ["l_quantity", "l_tax"]}
    out = features.missingness_features(lines(spark, sf_dir), groups, WIDE)
    return rounded(out.groupBy("f_pair", "f_base", F.col("f_row_missing_rate").cast("double").alias("rate")).agg(F.count(F.lit(1)).alias("n")))


def missing_share_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.missing_shares(lines(spark, sf_dir), WIDE))


def missing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    frozen = features.missing_shares(rows.where("l_orderkey % 2 = 0"), WIDE)
    return rounded(features.missing_drift(features.missing_shares(rows.where("l_orderkey % 3 != 1"), WIDE), frozen))


def recode_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("target", F.when(F.col("toxic") == 1, 1).otherwise(-1))
    return rounded(features.recode_target(rows).groupBy("target", "is_fail").agg(F.count(F.lit(1)).alias("n")))


def column_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.column_quality(lines(spark, sf_dir), WIDE, "fail"), 5)


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.column_quality(lines(spark, sf_dir), WIDE, "fail")).select("column_name", "verdict")


def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.pairwise_correlation(lines(spark, sf_dir), WIDE))


def corr_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    missing = {x["column_name"]: x["missing_pct"] for x in features.missing_shares(rows, WIDE).collect()}
    dropped = quality.prune_correlated(quality.pairwise_correlation(rows, WIDE), missing)
    return spark.createDataFrame([(c,) for c in dropped], "column_name string")


def hedges_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.hedges_g(lines(spark, sf_dir), WIDE, "fail"))


def hedges_g_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.hedges_g(lines(spark, sf_dir), WIDE, "fail", totals=False))


def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select_features(quality.hedges_g(lines(spark, sf_dir), WIDE, "fail"), g_min=0.005, k_min=2, k_max=3, floor=2).select("column_name")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    old = parts.select(F.concat(F.lit("s"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("column_name"), F.lit("feature_raw").alias("role"), F.lit("active").alias("status"), F.col("p_partkey").cast("int").alias("col_index"), F.lit(0.0).alias("missing_pct"), F.lit(None).cast("string").alias("derived_from"), F.lit(None).cast("string").alias("notes"))
    new = old.where("col_index > 45").select("column_name", F.lit("feature_eng").alias("role"), F.lit("active").alias("status"), (F.col("col_index") + 100).alias("col_index"))
    out = registry.retire(registry.upsert(old, new), ["s000000001", "s000000002"], "constant")
    return rounded(out.select("column_name", "role", "status", "col_index", F.coalesce("notes", F.lit("")).alias("notes")))


def _new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")


def committed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refreshed, appended, upserted and deleted in commits; a writer that began before them fails."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    store = _new_store(spark)
    change = store.begin()
    change.refresh("orders", o.where("o_orderdate < timestamp'1997-01-01'"))
    change.commit()
    stale, change = store.begin(), store.begin()
    change.append("orders", o.where("o_orderdate >= timestamp'1997-01-01'"), "o_orderkey")
    change.upsert("orders", o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")
    change.delete("orders", F.col("o_orderkey") % 7 == 0)
    version = change.commit()
    stale.delete("orders", F.col("o_orderkey") % 2 == 0)
    try:
        stale.commit()
    except Conflict:
        return rounded(store.read("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.lit(version).cast("long").alias("version")), 2)
    raise RuntimeError("a stale writer has committed")


def committed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in one commit, columns retired in the next; the rows of both versions."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("column_name"), F.lit("feature_raw").alias("role"), F.lit("active").alias("status"), F.col("p_partkey").cast("int").alias("col_index"))
    store = _new_store(spark)
    change = store.begin()
    change.create("registry", registry.REGISTRY)
    change.upsert("registry", parts, "column_name")
    change.refresh("ledger", parts.groupBy("role").agg(F.count(F.lit(1)).alias("n")))
    first = change.commit()
    change = store.begin()
    retire(change, "registry", ["s3", "s5"], "constant")
    change.commit()
    every = store.read("registry", first).withColumn("version", F.lit(0)).unionByName(store.read("registry").withColumn("version", F.lit(1))).join(F.broadcast(store.read("ledger")), "role")
    return rounded(every.groupBy("version", "status", F.coalesce("notes", F.lit("")).alias("notes")).agg(F.count(F.lit(1)).alias("columns"), F.max("n").alias("n")))


def ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a = events.groupBy("event_type").agg(F.max("event_id").alias("last_id")).withColumn("type", F.lit("spc"))
    b = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.lit("monitor"))
    return registry.append_union(a, b).select("event_type", "type", F.coalesce("last_id", F.lit(-1)).alias("last_id"), F.coalesce("n", F.lit(-1)).alias("n"))


def resolve_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    run = F.concat(F.lit("run"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    train = o.where("o_orderkey % 5 = 0").select(run.alias("run_id"), F.lit("").alias("type"), F.lit(None).cast("string").alias("parent_run"))
    parent = F.concat(F.lit("run"), F.lpad((F.floor(F.col("o_orderkey") / 5) * 5).cast("string"), 12, "0"))
    cal = o.where("o_orderkey % 5 != 0").select(run.alias("run_id"), F.lit("calibrate").alias("type"), parent.alias("parent_run"))
    return monitoring.resolve_bundle(train.unionByName(cal))


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table_fingerprint(table(spark, sf_dir, "orders"))


def data_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last loads of a ledger of which each order is a load of its priority's file."""
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ingest_id"), F.col("o_orderpriority").alias("source_file"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("source_sha256"))
    out = readers.data_fingerprint(log, "SELECT 1", files=7)
    return out.select(F.explode("raw").alias("source_file", "source_sha256"), "extract_sql_sha256")


def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in date order over several files; the place of each row as the files are read one after the other."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    path = f"{folder(spark)}/ordered-{uuid.uuid4().hex}"
    artifacts.write_ordered(o, ["o_orderdate", "o_orderkey"], path, rows=max(1, o.count() // 5))
    files = spark.createDataFrame([(f.rpartition("/")[2], k) for k, f in enumerate(artifacts.ordered_files(spark, path))], "file string, number long")
    rows = spark.read.parquet(f"{path}/data").select("o_orderkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).join(F.broadcast(files), "file")
    return positions(rows, [F.col("number"), F.col("at")], "place").select("o_orderkey", "place")


def csv_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of each customer's largest order written as text of six digits and read back."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("o_totalprice")).alias("share"), F.max(F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority"))).alias("top"))
    path = f"{folder(spark)}/digits-{uuid.uuid4().hex}"
    artifacts.write_csv(spent, path)
    return rounded(artifacts.read_csv(spark, path, "o_custkey long, n long, share double, top string"))


def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(registry.dataset_card(lines(spark, sf_dir).select("l_orderkey", "fail"), "fail"))


def named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_view")
    return readers.run_query(spark, "SELECT o_orderpriority, count(*) AS n FROM orders_view WHERE o_orderdate BETWEEN timestamp(:a) AND timestamp(:b) GROUP BY o_orderpriority", a="1997-01-01", b="1998-12-31")


QUERIES = {f.__name__: f for f in (extract_split, boundary_collisions, any_null_flags, missing_share_by_column, missing_drift, recode_target, column_quality, quality_verdicts, pairwise_corr, corr_pruned, hedges_g, hedges_g_observed, select_features, registry_upsert, committed_orders, committed_registry, ledger_union, resolve_bundle, table_fingerprint, data_fingerprint, ordered_output, csv_digits, dataset_card, named_query)}

_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in WIDE)
_QUALITY = f"""WITH {LONG_SQL}, b AS (SELECT count(*) AS n, avg(fail::DOUBLE) AS base FROM li),
    v AS (SELECT column_name, value, count(*) AS n, sum(fail) AS fails FROM lo WHERE value IS NOT NULL GROUP BY ALL),
    t AS (SELECT column_name, value, n, fails, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn, count(*) OVER (PARTITION BY column_name) AS nu,
        sum(n) OVER (PARTITION BY column_name) AS obs, sum(fails) OVER (PARTITION BY column_name) AS of FROM v),
    m AS (SELECT column_name, avg(value) AS mean, stddev_samp(value) AS std FROM lo GROUP BY 1),
    q AS (SELECT column_name, 1 - obs / b.n::DOUBLE AS missing, nu AS n_unique, mean, std, CASE WHEN abs(mean) > 1e-12 THEN abs(std / mean) END AS cv, value AS dom_value, t.n / obs::DOUBLE AS dom_frac,
        (obs - t.n)::BIGINT AS n_deviant, CASE WHEN obs > t.n THEN (of - fails) / (obs - t.n)::DOUBLE / base END AS enrichment FROM t JOIN m USING (column_name), b WHERE rn = 1)"""
_HEDGES = """WITH {long}, s AS (SELECT column_name, {n1} AS n1, {n0} AS n0, avg(value) FILTER (fail = 1) AS m1, avg(value) FILTER (fail = 0) AS m0, var_samp(value) FILTER (fail = 1) AS v1, var_samp(value) FILTER (fail = 0) AS v0 FROM lo GROUP BY 1),
    p AS (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS sp FROM s), h AS (SELECT column_name, CASE WHEN sp > 0 THEN abs((m1 - m0) / sqrt(sp) * (1 - 3 / (4 * (n1 + n0) - 9.0::DOUBLE))) ELSE 0 END AS g FROM p)"""
_G = _HEDGES.format(long=LONG_SQL, n1="count(*) FILTER (fail = 1)", n0="count(*) FILTER (fail = 0)")

ORACLE_SQL = {
    "extract_split": f"""SELECT CASE WHEN o_orderdate >= TIMESTAMP '{EXCLUDE}' THEN 'excluded' WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 'cv' ELSE 'holdout' END AS split,
        count(*) AS n, round(max(o_totalprice), 6) AS top, min(o_orderdate) AS first FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1""",
    "boundary_collisions": f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (TIMESTAMP '{CUTOFF}', TIMESTAMP '{EXCLUDE}')",
    "any_null_flags": f"WITH {LINES_SQL} SELECT (sparse IS NULL OR collinear IS NULL)::BIGINT AS f_pair, (l_quantity IS NULL OR l_tax IS NULL)::BIGINT AS f_base, round(({_NULLS}) / 8.0::DOUBLE, 6) AS rate, count(*) AS n FROM li GROUP BY ALL",
    "missing_share_by_column": f"WITH {LONG_SQL} SELECT column_name, round(avg((value IS NULL)::INT), 6) AS missing_pct FROM lo GROUP BY 1",
    "missing_drift": f"""WITH {LONG_SQL}, a AS (SELECT column_name, avg((value IS NULL)::INT) FILTER (l_orderkey % 3 != 1) AS m, avg((value IS NULL)::INT) FILTER (l_orderkey % 2 = 0) AS f FROM lo GROUP BY 1)
        SELECT column_name, round(m, 6) AS missing_pct, round(f, 6) AS frozen_pct, round(m - f, 6) + 0.0 AS delta, abs(m - f) > 0.02 AS flagged FROM a""",
    "recode_target": "SELECT CASE WHEN toxic = 1 THEN 1 ELSE -1 END::BIGINT AS target, (toxic = 1)::BIGINT AS is_fail, count(*) AS n FROM labels GROUP BY ALL",
    "column_quality": _QUALITY + " SELECT column_name, round(missing, 5) AS missing, n_unique, round(mean, 5) AS mean, round(std, 5) AS std, round(cv, 5) AS cv, round(dom_value, 5) AS dom_value, round(dom_frac, 5) AS dom_frac, n_deviant, round(enrichment, 5) AS enrichment FROM q",
    "quality_verdicts": _QUALITY + """ SELECT column_name, CASE WHEN n_unique = 1 THEN 'constant' WHEN missing > 0.5 THEN 'missing'
        WHEN (coalesce(dom_frac > 0.99, false) OR coalesce(cv < 0.01, false) OR n_unique < 5) AND NOT (n_deviant >= 5 AND coalesce(enrichment >= 2, false)) THEN 'near_zero_variance' ELSE 'keep' END AS verdict FROM q""",
    "pairwise_corr": "WITH " + LINES_SQL + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, " + ("NULL::DOUBLE" if "constant" in (a, b) else f"round(corr({a}, {b}), 6) + 0.0") + " AS r FROM li"
        for i, a in enumerate(sorted(WIDE)) for b in sorted(WIDE)[i + 1 :]
    ),
    "corr_pruned": f"""WITH {LONG_SQL}, m AS (SELECT column_name, avg((value IS NULL)::INT) AS q FROM lo GROUP BY 1),
        p AS (SELECT 'collinear' AS x, 'l_quantity' AS y, corr(collinear, l_quantity) AS r FROM li UNION ALL SELECT 'l_tax', 'sparse', corr(l_tax, sparse) FROM li)
        SELECT CASE WHEN a.q < b.q THEN y ELSE x END AS column_name FROM p JOIN m a ON a.column_name = x JOIN m b ON b.column_name = y WHERE abs(r) > 0.95""",
    "hedges_g": _G + " SELECT column_name, round(g, 6) AS g FROM h",
    "hedges_g_observed": _HEDGES.format(long=LONG_SQL, n1="count(value) FILTER (fail = 1)", n0="count(value) FILTER (fail = 0)") + " SELECT column_name, round(g, 6) AS g FROM h",
    "select_features": _G + ", k AS (SELECT column_name, row_number() OVER (ORDER BY g DESC, column_name) AS p, count(*) FILTER (g >= 0.005) OVER () AS s FROM h) SELECT column_name FROM k WHERE p <= CASE WHEN s < 2 THEN 2 ELSE least(s, 3) END",
    "registry_upsert": """SELECT 's' || lpad(p_partkey::VARCHAR, 9, '0') AS column_name, CASE WHEN p_partkey > 45 THEN 'feature_eng' ELSE 'feature_raw' END AS role, CASE WHEN p_partkey IN (1, 2) THEN 'excluded' ELSE 'active' END AS status,
        (p_partkey + CASE WHEN p_partkey > 45 THEN 100 ELSE 0 END)::BIGINT AS col_index, CASE WHEN p_partkey IN (1, 2) THEN 'constant' ELSE '' END AS notes FROM part""",
    "committed_orders": "SELECT o_orderkey, o_orderpriority, round(o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END, 2) AS o_totalprice, 1::BIGINT AS version FROM orders WHERE o_orderkey % 7 != 0",
    "committed_registry": """WITH v AS (SELECT 0 AS version, 'active' AS status, '' AS notes FROM part UNION ALL SELECT 1, CASE WHEN p_partkey IN (3, 5) THEN 'excluded' ELSE 'active' END, CASE WHEN p_partkey IN (3, 5) THEN 'constant' ELSE '' END FROM part)
        SELECT version::BIGINT AS version, status, notes, count(*) AS columns, (SELECT count(*) FROM part) AS n FROM v GROUP BY ALL""",
    "ledger_union": "SELECT event_type, 'spc' AS type, max(event_id) AS last_id, -1::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, 'monitor', -1, count(*) FROM events GROUP BY 1",
    "resolve_bundle": """WITH t AS (SELECT max('run' || lpad(o_orderkey::VARCHAR, 12, '0')) AS train_id FROM orders WHERE o_orderkey % 5 = 0),
        c AS (SELECT 'run' || lpad(o_orderkey::VARCHAR, 12, '0') AS id, 'run' || lpad((o_orderkey // 5 * 5)::BIGINT::VARCHAR, 12, '0') AS parent FROM orders WHERE o_orderkey % 5 != 0)
        SELECT train_id, max(id) AS calibrator_id FROM t LEFT JOIN c ON parent = train_id GROUP BY 1""",
    "table_fingerprint": """WITH h AS (SELECT md5(concat('|', o_orderkey::VARCHAR, '|', o_custkey::VARCHAR, '|', o_orderstatus, '|', o_totalprice::VARCHAR, '|', o_orderdate::VARCHAR, '|', o_orderpriority)) AS h FROM orders)
        SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 13))::BIGINT)::VARCHAR AS content_sum, bit_xor(('0x' || substr(h, 14, 13))::BIGINT) AS content_xor, md5('o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority') AS columns_md5 FROM h""",
    "data_fingerprint": "WITH l AS (SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey DESC LIMIT 7) SELECT o_orderpriority AS source_file, sha256(max(o_orderkey)::VARCHAR) AS source_sha256, sha256('SELECT 1') AS extract_sql_sha256 FROM l GROUP BY 1",
    "ordered_output": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders",
    "csv_digits": "SELECT o_custkey, count(*) AS n, round(printf('%.6g', sqrt(max(o_totalprice)))::DOUBLE, 6) AS share, max(o_orderpriority) FILTER (o_totalprice > 200000) AS top FROM orders GROUP BY 1",
    "dataset_card": "SELECT count(*) AS n_rows, 2::BIGINT AS n_columns, count(*) FILTER (l_returnflag = 'R') AS n_fail, round(avg((l_returnflag = 'R')::INT), 6) AS fail_rate, md5('l_orderkey|fail') AS columns_md5 FROM lineitem",
    "named_query": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1",
}
