"""Boosted models of lineitem and labelled documents: scores, folds, contributions, models on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import boosting, models, quality
from yieldspark.plans.evaluation import FOLDS_SQL
from yieldspark.plans.evaluation import ORACLE_SQL as EVALUATION_SQL
from yieldspark.plans.tables import LINES_SQL, SCORED_SQL, lines, r, rounded, scored_documents, table
from yieldspark.sources.staging import folder, stage

SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "sparse"]
#: One tree of one split, so that SQL can follow: its rate, L1 and L2 terms.
STUMP = {"rounds": 1, "depth": 1, "rate": 0.3, "alpha": 3.0, "lam": 2.0}


def _by_order(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Lines averaged by order, staged: edges, bins and scores read them."""
    return stage(lines(spark, sf_dir).groupBy("l_orderkey").agg(*(F.avg(c).alias(c) for c in columns), F.max("fail").alias("fail")), "by_order")


def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_tax", "sparse", "collinear"]
    rows = _by_order(spark, sf_dir, columns)
    model = boosting.boosted(rows.where("l_orderkey % 5 != 0"), columns, "fail", rounds=5, rate=0.1)[0]
    return rows.where("l_orderkey % 5 = 0").select("l_orderkey", "fail", r(boosting.probability(model)).alias("score_raw"))


def contribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_tax", "sparse"]
    rows = _by_order(spark, sf_dir, columns)
    model = boosting.boosted(rows, columns, "fail", rounds=5, rate=0.1)[0]
    return rounded(boosting.importance(boosting.contributions(model, rows, "l_orderkey")))


def _stump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boosting.Boosted]:
    rows = lines(spark, sf_dir)
    return rows, boosting.boosted(rows, SENSORS, "fail", **STUMP)[0]


def newton_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a one-split model of all lines: split, direction of nulls, leaf values and hessians."""
    return rounded(boosting.nodes(spark, _stump(spark, sf_dir)[1]).select("node", "feature", "cut", "nulls_left", "value", "cover"), 9)


def stump_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute contribution of each column to the one-split model."""
    rows, model = _stump(spark, sf_dir)
    return rounded(boosting.importance(boosting.contributions(model, rows, "l_orderkey")), 9)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("double").alias("quality")).join(sizes, "doc_id", "left")


def _trained(spark: SparkSession, sf_dir: str, **params) -> tuple[DataFrame, DataFrame]:
    return models.cross_validated(_labelled(spark, sf_dir), "doc_id", "toxic", ["n_chars", "quality"], **({"folds": 3, "repeats": 2, "rounds": 6, "depth": 3, "rate": 0.1} | params))


def cv_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows of cross-validated models by repeat and fold: each key once a repeat."""
    scores, _ = _trained(spark, sf_dir)
    return scores.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_keys"), F.sum("toxic").alias("n_fail"), F.count_if(F.col("p").between(0, 1)).alias("n_scored"))


def cv_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees and metrics of each cross-validated fit."""
    return rounded(_trained(spark, sf_dir)[1].drop("features"))


def cv_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sensor is chosen inside a fold, by its effect size on that fold's training rows."""
    rows = lines(spark, sf_dir).withColumn("id", F.concat_ws("-", "l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    rows = rows.groupBy("id").agg(F.max("fail").alias("fail"), *(F.max(c).alias(c) for c in SENSORS))
    chosen = lambda part: [r["column_name"] for r in quality.select_features(quality.hedges_g(part, SENSORS, "fail"), g_min=0.01, k_min=2, k_max=3, floor=2).collect()]
    _, fits = models.cross_validated(rows, "id", "fail", SENSORS, folds=3, repeats=1, select=chosen, **STUMP)
    return rounded(models.selection_counts(fits))


def cv_stump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean out-of-fold score of each document by one-split models, three repeats of five folds."""
    scores, _ = _trained(spark, sf_dir, folds=5, repeats=3, **STUMP)
    return rounded(scores.groupBy("doc_id").agg(F.avg("p").alias("p"), F.count("p").alias("n_repeats")))


def cv_stump_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier of those models by repeat and overall: mean and deviation over folds."""
    _, fits = _trained(spark, sf_dir, folds=5, repeats=3, **STUMP)
    out = fits.groupingSets([["repeat"], []], "repeat").agg(F.avg("brier").alias("mean"), F.stddev_samp("brier").alias("std"), F.count("brier").alias("n"))
    return rounded(out.select(F.coalesce("repeat", F.lit(0)).alias("repeat"), "mean", "std", "n"))


def isotonic_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by a calibrator that was fitted, saved and loaded."""
    rows = scored_documents(spark, sf_dir)
    path = f"{folder(spark)}/isotonic-{uuid.uuid4().hex}"
    models.save_model(models.isotonic(rows, "p", "y"), path)
    return models.calibrated(models.load_model(spark, path), rows).select("doc_id", r("p", 9).alias("p"), r("p_cal", 6).alias("p_cal"))


QUERIES = {f.__name__: f for f in (gbt_score, contribution_importance, newton_stump, stump_contributions, cv_coverage, cv_fits, cv_selection, cv_stump_scores, cv_stump_metrics, isotonic_queue)}

_PART = lambda g, h: f"(greatest(abs({g} / 1048576) - 3.0::DOUBLE, 0) * greatest(abs({g} / 1048576) - 3.0::DOUBLE, 0) / ({h} / 1048576 + 2.0::DOUBLE))"
_VALUE = lambda g, h: f"(-0.3::DOUBLE * sign({g}) * greatest(abs({g} / 1048576) - 3.0::DOUBLE, 0) / ({h} / 1048576 + 2.0::DOUBLE))"
#: From cells (model, train, y, feature number, v, a row each) and models (model, w): the best split of each model.
_SPLIT_SQL = f"""
    vals AS (SELECT feature, v, count(DISTINCT id) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
    run AS (SELECT feature, v, row_number() OVER w AS nth, sum(n) OVER w AS upto, count(*) OVER (PARTITION BY feature) AS k, sum(n) OVER (PARTITION BY feature) AS total FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
    bins AS (SELECT feature, v, dense_rank() OVER (PARTITION BY feature ORDER BY CASE WHEN k <= 511 THEN nth ELSE (upto - 1) * 511 // total END) AS bin FROM run),
    ends AS (SELECT feature, bin, max(v) AS v FROM bins GROUP BY ALL),
    sums AS (SELECT c.model, c.feature, bin, sum(round((0.5::DOUBLE - y) * CASE WHEN y = 1 THEN w ELSE 1.0::DOUBLE END * 1048576)) AS g, sum(round(0.25::DOUBLE * CASE WHEN y = 1 THEN w ELSE 1.0::DOUBLE END * 1048576)) AS h
        FROM cells c JOIN models USING (model) LEFT JOIN bins b ON b.feature = c.feature AND b.v = c.v WHERE train GROUP BY ALL),
    whole AS (SELECT model, feature, sum(g) AS g, sum(h) AS h, coalesce(sum(g) FILTER (bin IS NULL), 0) AS g0, coalesce(sum(h) FILTER (bin IS NULL), 0) AS h0 FROM sums GROUP BY ALL),
    upto AS (SELECT w.model, w.feature, e.bin, w.g, w.h, w.g0, w.h0, sum(coalesce(s.g, 0)) OVER o AS gp, sum(coalesce(s.h, 0)) OVER o AS hp
        FROM whole w JOIN ends e USING (feature) LEFT JOIN sums s ON s.model = w.model AND s.feature = w.feature AND s.bin = e.bin WINDOW o AS (PARTITION BY w.model, w.feature ORDER BY e.bin)),
    cuts AS (SELECT model, feature, bin, g, h, true AS nulls_left, gp + g0 AS gl, hp + h0 AS hl FROM upto UNION ALL SELECT model, feature, bin, g, h, false, gp, hp FROM upto),
    gains AS (SELECT *, {_PART('gl', 'hl')} + {_PART('(g - gl)', '(h - hl)')} - {_PART('g', 'h')} AS gain FROM cuts WHERE hl >= 1048576 AND h - hl >= 1048576),
    best AS (SELECT * FROM gains WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature, nulls_left DESC, bin) = 1)"""
_LINE_CELLS = f"""{LINES_SQL}, cells AS (SELECT 1 AS model, true AS train, id, fail AS y, feature, v FROM (SELECT id, fail, unnest(range(1, {len(SENSORS) + 1})) AS feature, unnest([{", ".join(SENSORS)}]) AS v FROM (SELECT *, row_number() OVER () AS id FROM li))),
    models AS (SELECT 1 AS model, count(*) FILTER (fail = 0)::DOUBLE / count(*) FILTER (fail = 1) AS w FROM li), {_SPLIT_SQL}"""
_NAMES = "[" + ", ".join(f"'{c}'" for c in SENSORS) + "]"
_DOC_CELLS = f"""{FOLDS_SQL}, d AS (SELECT doc_id, l.toxic::INT AS y, l.quality::DOUBLE AS quality, n_chars::DOUBLE AS n_chars FROM labels l LEFT JOIN documents USING (doc_id)),
    each AS (SELECT m.model, d.*, f.fold != (m.model - 1) % 5 AS train FROM range(1, 16) m(model), d JOIN f ON f.doc_id = d.doc_id WHERE f.repeat = (m.model - 1) // 5 + 1),
    cells AS (SELECT model, train, doc_id AS id, y, unnest([1, 2]) AS feature, unnest([n_chars, quality]) AS v FROM each),
    models AS (SELECT model, count(*) FILTER (y = 0)::DOUBLE / count(*) FILTER (y = 1) AS w FROM each WHERE train GROUP BY 1), {_SPLIT_SQL},
    totals AS (SELECT model, max(g) AS g, max(h) AS h FROM whole WHERE feature = 1 GROUP BY 1),
    oof AS (SELECT e.model, e.doc_id, e.y, 1 / (1 + exp(-CASE WHEN s.model IS NULL THEN {_VALUE('t.g', 't.h')} WHEN coalesce(b.bin <= s.bin, s.nulls_left) THEN {_VALUE('s.gl', 's.hl')} ELSE {_VALUE('(s.g - s.gl)', '(s.h - s.hl)')} END)) AS p
        FROM each e JOIN totals t USING (model) LEFT JOIN best s USING (model) LEFT JOIN bins b ON b.feature = s.feature AND b.v = CASE s.feature WHEN 1 THEN e.n_chars ELSE e.quality END WHERE NOT train)"""
ORACLE_SQL = {
    "cv_coverage": f"WITH {FOLDS_SQL.replace('range(1, 4)', 'range(1, 3)').replace('% 5)', '% 3)')} SELECT repeat, fold, count(*) AS n, count(DISTINCT doc_id) AS n_keys, sum(toxic)::BIGINT AS n_fail, count(*) AS n_scored FROM f GROUP BY ALL",
    "cv_selection": f"""WITH {LINES_SQL}, u AS (SELECT concat_ws('-', l_orderkey, l_quantity, l_extendedprice, l_tax, l_discount) AS id, max(fail) AS fail, {", ".join(f"max({c}) AS {c}" for c in SENSORS)} FROM li GROUP BY 1),
        f AS (SELECT *, (row_number() OVER (PARTITION BY fail ORDER BY md5('1|1337|' || id), id) - 1) % 3 AS fold FROM u),
        c AS (SELECT m, fail, unnest([{", ".join(f"'{c}'" for c in SENSORS)}]) AS feature, unnest([{", ".join(SENSORS)}]) AS v FROM f, range(3) t(m) WHERE fold != m),
        s AS (SELECT m, feature, count(*) FILTER (fail = 1) AS n1, count(*) FILTER (fail = 0) AS n0, avg(v) FILTER (fail = 1) AS m1, avg(v) FILTER (fail = 0) AS m0, var_samp(v) FILTER (fail = 1) AS v1, var_samp(v) FILTER (fail = 0) AS v0 FROM c GROUP BY ALL),
        p AS (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS sp FROM s), g AS (SELECT m, feature, CASE WHEN sp > 0 THEN abs((m1 - m0) / sqrt(sp) * (1 - 3 / (4 * (n1 + n0) - 9.0::DOUBLE))) ELSE 0 END AS g FROM p),
        k AS (SELECT m, feature, row_number() OVER (PARTITION BY m ORDER BY g DESC, feature) AS p, count(*) FILTER (g >= 0.01) OVER (PARTITION BY m) AS s FROM g)
        SELECT feature, count(*) AS n, round(count(*) / 3.0::DOUBLE, 6) AS share FROM k WHERE p <= CASE WHEN s < 2 THEN 2 ELSE least(s, 3) END GROUP BY 1""",
    "newton_stump": f"""WITH {_LINE_CELLS}
        SELECT 0::BIGINT AS node, {_NAMES}[b.feature] AS feature, round(CASE WHEN e.bin < (SELECT max(bin) FROM ends x WHERE x.feature = b.feature) THEN e.v END, 9) AS cut, nulls_left, round({_VALUE('g', 'h')}, 9) + 0.0 AS value, round(h / 1048576, 9) AS cover FROM best b JOIN ends e USING (feature, bin)
        UNION ALL SELECT 1, NULL, NULL, NULL, round({_VALUE('gl', 'hl')}, 9) + 0.0, round(hl / 1048576, 9) FROM best
        UNION ALL SELECT 2, NULL, NULL, NULL, round({_VALUE('(g - gl)', '(h - hl)')}, 9) + 0.0, round((h - hl) / 1048576, 9) FROM best""",
    "stump_contributions": f"""WITH {_LINE_CELLS}, v AS (SELECT *, {_VALUE('gl', 'hl')} AS l, {_VALUE('(g - gl)', '(h - hl)')} AS r, hl / h AS share FROM best)
        SELECT {_NAMES}[c.feature] AS feature, round(avg(CASE WHEN v.feature IS NULL THEN 0 WHEN coalesce(b.bin <= v.bin, v.nulls_left) THEN abs(l - (l * share + r * (1 - share))) ELSE abs(r - (l * share + r * (1 - share))) END), 9) + 0.0 AS mean_abs
        FROM cells c LEFT JOIN v ON v.feature = c.feature LEFT JOIN bins b ON b.feature = c.feature AND b.v = c.v GROUP BY 1""",
    "cv_stump_scores": f"WITH {_DOC_CELLS} SELECT doc_id, round(avg(p), 6) AS p, count(*) AS n_repeats FROM oof GROUP BY 1",
    "cv_stump_metrics": f"WITH {_DOC_CELLS}, b AS (SELECT (model - 1) // 5 + 1 AS repeat, avg((p - y) ** 2) AS b FROM oof GROUP BY model) SELECT coalesce(repeat, 0)::BIGINT AS repeat, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, count(*) AS n FROM b GROUP BY GROUPING SETS ((repeat), ())",
    "isotonic_queue": EVALUATION_SQL["isotonic_calibration"],
}
