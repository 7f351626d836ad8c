"""Exploratory statistics over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import eda
from yieldspark.plans.tables import LINES_SQL, LONG_SQL, NUMERIC, WIDE, lines, masked_events, r, rounded, table

TESTED = [*NUMERIC, "sparse", "collinear"]


def skew_kurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.shape_statistics(lines(spark, sf_dir), TESTED), 4)


def shape_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.shape_flags(eda.shape_statistics(lines(spark, sf_dir), [*TESTED, "rare"])).select("column_name", "skewed", "heavy_tailed", "zero_inflated")


def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.mann_whitney(lines(spark, sf_dir), TESTED, "fail").select("column_name", "u", "z"), 4)


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = lines(spark, sf_dir).groupBy((F.col("l_orderkey") % 23).alias("test")).agg(F.avg("fail").alias("p"))
    return rounded(eda.benjamini_hochberg(tests, "test"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.spearman(lines(spark, sf_dir), ["l_quantity", "l_tax", "sparse", "collinear"], "l_extendedprice"))


def tail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.tail_enrichment(lines(spark, sf_dir), TESTED, "fail"))


def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.variance_ratios(lines(spark, sf_dir), TESTED, "fail"))


def missing_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.missing_gap(lines(spark, sf_dir), WIDE, "fail"))


def dropout_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("sparse").alias("a"), F.max("collinear").alias("b"), F.max("l_tax").alias("c"))
    rows = rows.withColumns({"d": F.when(F.col("l_orderkey") % 3 == 0, 1.0), "e": F.when(F.col("l_orderkey") % 7 != 0, 2.0), "f": F.when(F.col("l_orderkey") % 2 == 0, 2.0)})
    return eda.dropout_cliques(rows, list("abcdef"), "l_orderkey")


def dropout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns null on the same orders but for one, and chains of such."""
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("sparse").alias("a"), F.max("collinear").alias("b"))
    top, o = rows.agg(F.max("l_orderkey")).first()[0], F.col("l_orderkey")
    masks = {"c": (o % 3 == 0) | (o == top), "d": (o % 3 == 0) & (o > 3), "e": (o % 7 != 0) & (o < top - 40), "f": o % 2 == 0, "g": F.lit(True), "h": F.lit(False), "i": (o % 2 == 0) & (o % 1000 != 0)}
    return eda.dropout_groups(rows.withColumns({n: F.when(m, 1.0) for n, m in masks.items()}), list("abcdefghi"))


def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.neighbour_information(table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey", F.floor(F.col("c_acctbal") / 500).alias("step"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment"), ["c_acctbal", "c_custkey", "step", "c_nationkey"], "c_mktsegment"))


def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("fail") == 1
    t = lines(spark, sf_dir).groupBy((F.col("l_orderkey") % 17).alias("k")).agg(*(F.count_if(c).alias(n) for n, c in {"a": (F.col("l_quantity") > 25) & y, "b": (F.col("l_quantity") > 25) & ~y, "c": (F.col("l_quantity") <= 25) & y, "d": (F.col("l_quantity") <= 25) & ~y}.items()))
    return eda.fisher_exact(t, "k").select("k", r("p").alias("p"))


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.mutual_information(lines(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_tax"], "fail", 8))


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.rolling_mean(masked_events(spark, sf_dir), ["event_type"], ["ts", "event_id"], "x").select("event_id", "rolling_mean"))


def group_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.group_offset(masked_events(spark, sf_dir), ["event_type"], "x").select("event_id", "offset"))


QUERIES = {f.__name__: f for f in (skew_kurt, shape_flags, mann_whitney, bh_fdr, spearman, tail_enrichment, variance_ratio, missing_gap, dropout_cliques, dropout_groups, fisher_exact, mutual_information, neighbour_information, rolling_mean, group_offset)}

_IN = lambda cs: "(" + ", ".join(f"'{c}'" for c in cs) + ")"
_MW = f"""WITH {LONG_SQL}, g AS (SELECT column_name, value, count(*) AS n, count(*) FILTER (fail = 1) AS k FROM lo WHERE value IS NOT NULL AND column_name IN {_IN(TESTED)} GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY column_name ORDER BY value) - n + (n + 1) / 2.0::DOUBLE AS mid FROM g),
    s AS (SELECT column_name, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS n1, sum(k * mid) AS r1, sum(n::DOUBLE ** 3 - n) AS ties FROM m GROUP BY 1), u AS (SELECT *, n - n1 AS n0, r1 - n1 * (n1 + 1) / 2 AS u FROM s)"""
_Q = LONG_SQL + f", qq AS (SELECT column_name, quantile_cont(value, {{lo}}) AS a, quantile_cont(value, {{hi}}) AS b FROM lo WHERE column_name IN {_IN(TESTED)} GROUP BY 1)"
ORACLE_SQL = {
    "group_offset": "WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 != 0 THEN value END AS x FROM events) SELECT event_id, round(x - min(x) OVER (PARTITION BY event_type), 6) + 0.0 AS \"offset\" FROM e",
    "skew_kurt": f"WITH {LONG_SQL} SELECT column_name, count(value) AS n, round(skewness(value), 4) + 0.0 AS skew, round(kurtosis(value), 4) + 0.0 AS kurtosis, round(avg((value = 0)::INT), 4) AS pct_zeros FROM lo WHERE column_name IN {_IN(TESTED)} GROUP BY 1",
    "shape_flags": f"WITH {LONG_SQL} SELECT column_name, coalesce(abs(skewness(value)) > 2, false) AS skewed, coalesce(kurtosis(value) > 7, false) AS heavy_tailed, coalesce(avg((value = 0)::INT) > 0.5, false) AS zero_inflated FROM lo WHERE column_name IN {_IN([*TESTED, 'rare'])} GROUP BY 1",
    "mann_whitney": _MW + " SELECT column_name, round(u, 4) AS u, round(greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 4) AS z FROM u",
    "bh_fdr": f"WITH {LINES_SQL}, t AS (SELECT l_orderkey % 23 AS test, avg(fail) AS p FROM li GROUP BY 1), w AS (SELECT test, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, test) AS raw FROM t) SELECT test, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM w",
    "spearman": f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr(a, b), 6) + 0.0 AS rho FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM li WHERE {c} IS NOT NULL)" for c in ("l_quantity", "l_tax", "sparse", "collinear")),
    "tail_enrichment": f"WITH {_Q.format(lo=0.05, hi=0.95)} SELECT column_name, round(avg(fail) FILTER (value IS NOT NULL), 6) AS base_rate, round(avg(fail) FILTER (value > b) / avg(fail) FILTER (value IS NOT NULL), 6) AS upper, round(avg(fail) FILTER (value < a) / avg(fail) FILTER (value IS NOT NULL), 6) AS lower FROM lo JOIN qq USING (column_name) GROUP BY 1",
    "variance_ratio": f"""WITH {_Q.format(lo=0.01, hi=0.99)}, c AS (SELECT column_name, fail, value, greatest(least(value, b), a) AS cut FROM lo JOIN qq USING (column_name) WHERE value IS NOT NULL)
        SELECT column_name, round(var_samp(value) FILTER (fail = 1) / var_samp(value) FILTER (fail = 0), 6) AS raw, round(var_samp(cut) FILTER (fail = 1) / var_samp(cut) FILTER (fail = 0), 6) AS clipped,
            round((quantile_cont(value, 0.75) FILTER (fail = 1) - quantile_cont(value, 0.25) FILTER (fail = 1)) / (quantile_cont(value, 0.75) FILTER (fail = 0) - quantile_cont(value, 0.25) FILTER (fail = 0)), 6) AS iqr FROM c GROUP BY 1""",
    "missing_gap": f"WITH {LONG_SQL} SELECT column_name, round(avg((value IS NULL)::INT) FILTER (fail = 1) - avg((value IS NULL)::INT) FILTER (fail = 0), 6) + 0.0 AS gap FROM lo GROUP BY 1",
    "dropout_cliques": f"WITH {LINES_SQL}, k AS (SELECT DISTINCT l_orderkey AS o FROM li), c AS (SELECT count(*) FILTER (o % 3 != 0) AS t, count(*) FILTER (o % 7 = 0) AS s, count(*) FILTER (o % 2 != 0) AS h FROM k) SELECT v.* FROM c, (VALUES ('a', c.t, 'a'), ('d', c.t, 'a'), ('b', c.s, 'b'), ('e', c.s, 'b'), ('f', c.h, 'f')) v(column_name, n_missing, clique)",
    "dropout_groups": f"""WITH RECURSIVE {LINES_SQL}, k AS (SELECT DISTINCT l_orderkey AS o, max(l_orderkey) OVER () AS top FROM li),
        m AS (SELECT o, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i']) AS c, unnest([o % 3 != 0, o % 7 = 0, o % 3 != 0 AND o != top, o % 3 != 0 OR o <= 3, o % 7 = 0 OR o >= top - 40, o % 2 != 0, false, true, o % 2 != 0 OR o % 1000 = 0]) AS z FROM k),
        s AS (SELECT c, count(*)::DOUBLE AS n, count(*) FILTER (z)::DOUBLE AS a FROM m GROUP BY 1), p AS (SELECT x.c AS i, y.c AS j, count(*) FILTER (x.z AND y.z) AS ab FROM m x JOIN m y USING (o) WHERE x.c != y.c GROUP BY ALL),
        l AS (SELECT i, j FROM p JOIN s x ON x.c = i JOIN s y ON y.c = j WHERE x.a > 0 AND y.a > 0 AND x.a < x.n AND y.a < y.n AND (x.n * ab - x.a * y.a) / sqrt(x.a * (x.n - x.a) * y.a * (y.n - y.a)) >= 0.999),
        reach AS (SELECT c AS i, c AS j FROM s WHERE a > 0 UNION SELECT r.i, l.j FROM reach r JOIN l ON l.i = r.j), g AS (SELECT i, min(j) AS g, count(*) AS n FROM reach GROUP BY 1)
        SELECT c AS column_name, a::BIGINT AS n_missing, g AS "group", g.n AS n_columns FROM g JOIN s ON s.c = g.i""",
    "neighbour_information": """WITH v AS (SELECT c_custkey AS id, c_mktsegment AS y, unnest(['c_acctbal', 'c_custkey', 'step', 'c_nationkey']) AS c, unnest([c_acctbal::DOUBLE, c_custkey::DOUBLE, floor(c_acctbal / 500)::DOUBLE, CASE WHEN c_custkey % 5 != 0 THEN c_nationkey END::DOUBLE]) AS x FROM customer),
        w AS (SELECT *, count(*) OVER (PARTITION BY c, y) AS size FROM v WHERE x IS NOT NULL AND y IS NOT NULL), u AS (SELECT * FROM w WHERE size > 1),
        d AS (SELECT a.c, a.id, a.x, a.size, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.c, a.id ORDER BY abs(a.x - b.x)) AS rn FROM u a JOIN u b ON a.c = b.c AND a.y = b.y AND a.id != b.id),
        k AS (SELECT c, id, x, size, least(size - 1, 5) AS k, d FROM d WHERE rn = least(size - 1, 5)),
        m AS (SELECT k.c, k.id, k.size, k.k, count(*) AS m FROM k JOIN u ON u.c = k.c AND CASE WHEN k.d = 0 THEN u.x = k.x ELSE abs(u.x - k.x) < k.d END GROUP BY ALL),
        top AS (SELECT max(size) + (SELECT count(*) FROM customer) AS t FROM u), psi AS (SELECT n, sum(1 / (n - 1)::DOUBLE) OVER (ORDER BY n) - 0.5772156649015329 AS p FROM range(2, (SELECT t FROM top) + 1) r(n) UNION ALL SELECT 1, -0.5772156649015329),
        t AS (SELECT c, count(*) AS n, avg(a.p - b.p - e.p) AS t FROM m JOIN psi a ON a.n = m.k JOIN psi b ON b.n = m.size JOIN psi e ON e.n = m.m GROUP BY 1)
        SELECT c AS column_name, t.n, round(greatest(psi.p + t, 0), 6) AS mi FROM t JOIN psi ON psi.n = t.n""",
    "fisher_exact": f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey % 17 AS k, count(*) FILTER (l_quantity > 25 AND fail = 1) AS a, count(*) FILTER (l_quantity > 25) AS r, count(*) FILTER (fail = 1) AS m, count(*) AS n FROM li GROUP BY 1),
        x AS (SELECT *, unnest(range(greatest(0, r + m - n), least(r, m) + 1)) AS x FROM t), p AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(m + 1) + lgamma(n - m + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(m - x + 1) - lgamma(n - r - m + x + 1)) AS p FROM x),
        s AS (SELECT k, p, max(p) FILTER (x = a) OVER (PARTITION BY k) AS seen FROM p) SELECT k, round(least(1, sum(p)), 6) AS p FROM s WHERE p <= seen * (1 + 1e-7) GROUP BY k""",
    "mutual_information": f"""WITH {LONG_SQL}, q AS (SELECT column_name, quantile_cont(value, [{', '.join(f'{k}::DOUBLE / 8' for k in range(1, 8))}]) AS e FROM lo WHERE column_name IN ('l_quantity', 'l_extendedprice', 'l_tax') GROUP BY 1),
        b AS (SELECT column_name, fail, len(list_filter(e, lambda t: value > t)) AS x FROM lo JOIN q USING (column_name) WHERE value IS NOT NULL), c AS (SELECT column_name, x, fail, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
        d AS (SELECT column_name, n, sum(n) OVER (PARTITION BY column_name) AS t, sum(n) OVER (PARTITION BY column_name, x) AS nx, sum(n) OVER (PARTITION BY column_name, fail) AS ny FROM c) SELECT column_name, round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 AS mi FROM d GROUP BY 1""",
    "rolling_mean": "WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 7 != 0 THEN value END AS x FROM events) SELECT event_id, round(CASE WHEN count(x) OVER w = 10 THEN avg(x) OVER w END, 6) AS rolling_mean FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 9 PRECEDING)",
}
