"""Design-of-experiments and out-of-distribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import boosting, doe
from yieldspark.plans.tables import lines, rounded, table

NAMES = ["l_quantity", "l_extendedprice", "l_tax"]
CODED = [f"{n}_coded" for n in NAMES]


def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.factor_levels(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


def rank_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("factor"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("importance"))
    return rounded(doe.rank_factors(c, "s7"))


def _factors(spark: SparkSession, sf_dir: str) -> list[dict]:
    """Levels at the 10, 50 and 90 % quantiles of the lines' sensors (a row a factor)."""
    levels = {r["factor"]: r for r in doe.factor_levels(table(spark, sf_dir, "lineitem"), NAMES).collect()}
    return [{"name": n, "low": levels[n]["low"], "center": levels[n]["center"], "high": levels[n]["high"]} for n in NAMES]


def factorial_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.factorial_design(spark, _factors(spark, sf_dir), replicates=2, centers=2, seed=1337))


def fractional_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.factorial_design(spark, _factors(spark, sf_dir), generator="a b ab").select("run_id", *CODED, *NAMES))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analytic surrogate over every supplier and design row."""
    background = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("wafer_id"), (F.col("s_acctbal") / 1e5).alias("b"))
    rows = doe.expand_design(background, doe.factorial_design(spark, _factors(spark, sf_dir), centers=1), NAMES)
    a, b, c = map(F.col, CODED)
    p = 0.3 + 0.1 * a + 0.05 * b - 0.02 * c + 0.03 * a * b + F.col("b")
    return rows.withColumn("p", p).withColumn("y", (F.pmod(F.col("wafer_id") * 7 + F.col("design_row") * 13, F.lit(100)) < 100 * p).cast("int"))


def design_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_expanded(spark, sf_dir).groupBy("run_id", *NAMES).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doe.cell_summary(_expanded(spark, sf_dir), ["run_id", "is_center", *CODED], "p")


def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(spark, sf_dir))


def bernoulli_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.bernoulli_cells(_expanded(spark, sf_dir), ["run_id"], "y", "p"))


def main_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.main_effects(_cells(spark, sf_dir), CODED))


def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.curvature(_cells(spark, sf_dir), F.col("is_center")))


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.recommend(_cells(spark, sf_dir), "run_id"))


def ols_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.ols_effects(_cells(spark, sf_dir).where("not is_center"), CODED).select("term", "estimate"))


def glm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = doe.bernoulli_cells(_expanded(spark, sf_dir), ["run_id", *CODED], "y", "p")
    return rounded(doe.glm_effects(cells, CODED))


def glm_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors and their interaction over the four corners: as many effects as cells."""
    corners = _expanded(spark, sf_dir).where("not is_center")
    cells = doe.bernoulli_cells(corners, CODED[:2], "y", "p")
    return rounded(doe.glm_effects(cells, CODED[:2]).select("term", "estimate", "odds_ratio", "std_error"), 4)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doe.studentized_residuals(_cells(spark, sf_dir), CODED, "run_id").select("run_id", "fitted", "leverage"))


def surrogate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = ["l_quantity", "l_tax", "sparse"]
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(*(F.avg(c).alias(c) for c in sensors), F.max("fail").alias("fail"))
    model = boosting.boosted(rows, sensors, "fail", rounds=5, rate=0.1)[0]
    design = doe.factorial_design(spark, [{"name": "l_quantity", "low": 5.0, "high": 45.0}, {"name": "sparse", "low": 0.0, "high": 0.08}], centers=1)
    score = lambda df: df.withColumn("score_raw", boosting.probability(model))
    out = doe.score_design(rows, design, ["l_quantity", "sparse"], score, {"f_any": sensors}, sensors)
    return rounded(out.groupBy("run_id", "l_quantity", "sparse").agg(F.count(F.lit(1)).alias("n"), F.avg("score_raw").alias("p"), F.avg(F.col("f_row_missing_rate").cast("double")).alias("missing")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of the first and of the last half of the coordinates."""
    whole = lambda low: F.aggregate(F.slice("embedding", low, 32), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", whole(1).alias("e0"), whole(33).alias("e1"))


def _coordinates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{k}" for k in range(64)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", k).cast("double").alias(n) for k, n in enumerate(names))), names


def mahalanobis_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all 64 coordinates the squared distances of the reference's own rows add up to (n - 1) x 64."""
    p, names = _coordinates(spark, sf_dir)
    p = p.where("label < 5")
    out = doe.mahalanobis(p, p, names)
    return rounded(out.agg(F.count("mahalanobis").alias("n"), F.sum(F.col("mahalanobis") ** 2).alias("total")), 3)


def mahalanobis_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return rounded(doe.mahalanobis(p, p.where("label = 0"), ["e0", "e1"]).select("vec_id", "mahalanobis"), 5)


def knn_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return rounded(doe.knn_distance(p.where("vec_id % 20 = 0"), p.where("label = 0"), "vec_id", ["e0", "e1"]), 5)


def ood_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return rounded(doe.ood_table(p.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "run_id"), p.where("label = 0").withColumnRenamed("vec_id", "wafer_id"), ["e0", "e1"]).select("run_id", "mahalanobis", "knn_distance", "ood_flag"), 5)


QUERIES = {f.__name__: f for f in (factor_levels, rank_factors, factorial_design, fractional_design, design_expand, cell_summary, bernoulli_cells, main_effects, curvature, recommend, ols_effects, glm_effects, glm_saturated, residuals, surrogate_scores, mahalanobis_ood, mahalanobis_spread, knn_ood, ood_flags)}

_CORNERS = "co AS (SELECT a.v AS a, b.v AS b, c.v AS c, row_number() OVER (ORDER BY c.v, b.v, a.v) AS k FROM (VALUES (-1.0::DOUBLE), (1.0)) a(v), (VALUES (-1.0::DOUBLE), (1.0)) b(v), (VALUES (-1.0::DOUBLE), (1.0)) c(v))"
_LV = "lv AS (SELECT " + ", ".join(f"quantile_cont({n}, {q}) AS {v}_{k}" for v, n in zip("abc", NAMES, strict=True) for k, q in (("low", 0.1), ("mid", 0.5), ("high", 0.9))) + " FROM lineitem)"
_LEVELS = ", ".join(f"round(CASE WHEN {v} < 0 THEN {v}_low WHEN {v} > 0 THEN {v}_high ELSE {v}_mid END, 6) AS {n}" for v, n in zip("abc", NAMES, strict=True))
_DESIGN = _LV + ", " + _CORNERS + ", de AS (SELECT a, b, c, k, false AS is_center FROM co UNION ALL SELECT 0, 0, 0, 9, true)"
_ROWS = _DESIGN + f""", ex AS (SELECT 'doe_' || lpad(k::VARCHAR, 3, '0') AS run_id, k, is_center, a, b, c, {_LEVELS}, s_suppkey, 0.3 + 0.1 * a + 0.05 * b - 0.02 * c + 0.03 * a * b + s_acctbal / 1e5 AS p FROM de, supplier, lv),
    ce AS (SELECT run_id, is_center, a, b, c, count(*) AS n, avg(p) AS mean, coalesce(stddev_samp(p), 0) AS std FROM ex GROUP BY ALL)"""
_PTS = "pt AS (SELECT vec_id, label, list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) AS e0, list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)) AS e1 FROM embeddings)"
_KNN = "{name} AS (SELECT id, avg(d) AS knn FROM (SELECT q.vec_id AS id, sqrt((q.e0 - r.e0) ** 2 + (q.e1 - r.e1) ** 2) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt((q.e0 - r.e0) ** 2 + (q.e1 - r.e1) ** 2)) AS rn FROM (SELECT * FROM pt WHERE {which}) q, pt r WHERE r.label = 0) WHERE rn <= {k} GROUP BY 1)"
_MAH = "mo AS (SELECT avg(e0) AS m0, avg(e1) AS m1, var_samp(e0) AS v0, var_samp(e1) AS v1, covar_samp(e0, e1) AS v01 FROM pt WHERE label = 0), ma AS (SELECT vec_id, label, sqrt(greatest(((e0 - m0) ** 2 * v1 - 2 * (e0 - m0) * (e1 - m1) * v01 + (e1 - m1) ** 2 * v0) / (v0 * v1 - v01 * v01), 0)) AS m FROM pt, mo)"
_FIT = {"l_quantity_coded": "a", "l_extendedprice_coded": "b", "l_tax_coded": "c", "l_quantity_coded:l_extendedprice_coded": "a * b", "l_quantity_coded:l_tax_coded": "a * c", "l_extendedprice_coded:l_tax_coded": "b * c", "intercept": "1"}
ORACLE_SQL = {
    "factor_levels": " UNION ALL ".join(f"SELECT '{c}' AS factor, round(quantile_cont({c}, 0.1), 6) AS low, round(quantile_cont({c}, 0.5), 6) AS center, round(quantile_cont({c}, 0.9), 6) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")),
    "rank_factors": "WITH c AS (SELECT 's' || s_suppkey AS factor, CASE WHEN s_suppkey % 4 != 0 THEN s_acctbal END AS importance FROM supplier) SELECT factor, round(importance, 6) + 0.0 AS importance, row_number() OVER (ORDER BY (factor != 's7')::INT, importance DESC NULLS LAST, factor) AS place FROM c",
    "factorial_design": f"""WITH {_LV}, {_CORNERS}, d AS (SELECT a, b, c, k, false AS is_center, 1 AS r FROM co UNION ALL SELECT a, b, c, k + 8, false, 2 FROM co UNION ALL SELECT 0, 0, 0, 17 + i, true, 1 FROM range(2) t(i))
        SELECT 'doe_' || lpad(k::VARCHAR, 3, '0') AS run_id, k::BIGINT AS design_row, is_center, r::BIGINT AS replicate, a::DOUBLE AS l_quantity_coded, b::DOUBLE AS l_extendedprice_coded, c::DOUBLE AS l_tax_coded, {_LEVELS}, r > 1 AS is_replicate, row_number() OVER (ORDER BY md5('1337|' || k::VARCHAR)) AS run_order FROM d, lv""",
    "fractional_design": f"WITH {_LV}, q AS (SELECT a.v AS a, b.v AS b, a.v * b.v AS c, row_number() OVER (ORDER BY b.v, a.v) AS k FROM (VALUES (-1.0::DOUBLE), (1.0)) a(v), (VALUES (-1.0::DOUBLE), (1.0)) b(v)) SELECT 'doe_' || lpad(k::VARCHAR, 3, '0') AS run_id, a AS l_quantity_coded, b AS l_extendedprice_coded, c AS l_tax_coded, {_LEVELS} FROM q, lv",
    "design_expand": f"WITH {_ROWS} SELECT run_id, l_quantity, l_extendedprice, l_tax, count(*) AS n, round(sum(p), 6) AS total FROM ex GROUP BY ALL",
    "cell_summary": f"WITH {_ROWS} SELECT run_id, is_center, a AS l_quantity_coded, b AS l_extendedprice_coded, c AS l_tax_coded, n, round(mean, 6) AS mean, round(std, 6) AS std FROM ce",
    "bernoulli_cells": f"WITH {_ROWS} SELECT run_id, count(*) FILTER ((s_suppkey * 7 + k * 13) % 100 < 100 * p) AS failures, count(*) AS trials, round(avg(p), 6) AS expected FROM ex GROUP BY 1",
    "main_effects": f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{n}' AS factor, round(avg(mean) FILTER ({v} = -1), 6) AS low_mean, round(avg(mean) FILTER ({v} = 1), 6) AS high_mean, round(avg(mean) FILTER ({v} = 1) - avg(mean) FILTER ({v} = -1), 6) + 0.0 AS effect FROM ce" for n, v in zip(CODED, "abc", strict=True)),
    "curvature": f"WITH {_ROWS} SELECT round(avg(mean) FILTER (is_center), 6) AS center_mean, round(avg(mean) FILTER (NOT is_center), 6) AS corner_mean, count(*) FILTER (is_center) AS n_center, round(avg(mean) FILTER (is_center) - avg(mean) FILTER (NOT is_center), 6) + 0.0 AS curvature FROM ce",
    "recommend": f"WITH {_ROWS} SELECT run_id, round(mean, 6) AS mean FROM ce ORDER BY mean, run_id LIMIT 1",
    "ols_effects": f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{t}' AS term, round(avg(mean * {x}), 6) + 0.0 AS estimate FROM ce WHERE NOT is_center" for t, x in _FIT.items()),
    # with as many effects as cells the fit is exact: effects are contrasts of the cells' log odds
    "glm_saturated": f"""WITH {_ROWS}, c AS (SELECT a, b, count(*)::DOUBLE AS n, count(*) FILTER ((s_suppkey * 7 + k * 13) % 100 < 100 * p)::DOUBLE AS f FROM ex WHERE NOT is_center GROUP BY ALL),
        l AS (SELECT a, b, ln(f / (n - f)) AS l, 1 / f + 1 / (n - f) AS v FROM c), t AS (SELECT unnest(['intercept', '{CODED[0]}', '{CODED[1]}', '{CODED[0]}:{CODED[1]}']) AS term, unnest([1.0::DOUBLE, a, b, a * b]) AS x, l, v FROM l)
        SELECT term, round(sum(x * l) / 4, 4) + 0.0 AS estimate, round(exp(sum(x * l) / 4), 4) AS odds_ratio, round(sqrt(sum(v)) / 4, 4) AS std_error FROM t GROUP BY 1""",
    "residuals": f"""WITH {_ROWS}, b AS (SELECT avg(mean) AS m, {', '.join(f'sum({x} * mean) / 8 AS b{k}' for k, x in enumerate(_FIT.values()))} FROM ce)
        SELECT run_id, round(m + {' + '.join(f'b{k} * {x}' for k, x in enumerate(_FIT.values()) if x != '1')}, 6) AS fitted, round(1 / 9.0::DOUBLE + CASE WHEN is_center THEN 0 ELSE 0.75 END, 6) AS leverage FROM ce, b""",
    "mahalanobis_ood": f"WITH {_PTS}, {_MAH} SELECT vec_id, round(m, 5) AS mahalanobis FROM ma",
    "mahalanobis_spread": "SELECT count(*) AS n, round((count(*) - 1) * 64.0::DOUBLE, 3) AS total FROM embeddings WHERE label < 5",
    "knn_ood": f"WITH {_PTS}, {_KNN.format(name='kn', which='vec_id % 20 = 0', k=5)} SELECT id AS vec_id, round(knn, 5) AS knn_distance FROM kn",
    "ood_flags": f"""WITH {_PTS}, {_MAH}, {_KNN.format(name='kn', which='vec_id % 20 = 0', k=5)}, {_KNN.format(name='kr', which='label = 0', k=6)},
        th AS (SELECT (SELECT quantile_cont(m, 0.99) FROM ma WHERE label = 0) AS tm, (SELECT quantile_cont(knn, 0.99) FROM kr) AS tk)
        SELECT id AS run_id, round(m, 5) AS mahalanobis, round(knn, 5) AS knn_distance, m > tm OR knn > tk AS ood_flag FROM kn JOIN ma ON ma.vec_id = kn.id, th""",
}
