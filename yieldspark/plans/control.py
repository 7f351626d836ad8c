"""SPC, scoring and monitoring queries over the event stream and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import monitoring, spc
from yieldspark.plans.tables import EVENTS_SQL, masked_events, placed_events, rounded, table
from yieldspark.sources import artifacts

ORDER = ["ts", "event_id"]


def moving_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked_events(spark, sf_dir)
    return rounded(spc.moving_range(rows, "x", ["event_type"], ORDER).select("event_id", "mr"))


def _phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = placed_events(spark, sf_dir)
    return rows.where(F.col("pos") < n * 4 // 5)


def spc_limits_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spc.control_limits(_phase1(spark, sf_dir), "event_type", "x", ORDER))


def spc_limits_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spc.control_limits(_phase1(spark, sf_dir), "event_type", "x", ORDER, method="classic"))


def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spc.ewma(masked_events(spark, sf_dir), "event_type", "x", ORDER, F.lit(50.0))
    return rounded(out.select("event_id", "ewma"), 4)


def we_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spc.western_electric(masked_events(spark, sf_dir), ["event_type"], ORDER, (F.col("x") - 50) / 25)
    return out.select("event_id", "r1", "r2", "r3", "r4")


def imr_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masked_events(spark, sf_dir)
    limits = spc.control_limits(rows, "event_type", "x", ORDER)
    out = spc.imr_series(rows, limits, "event_type", "x", ORDER)
    return rounded(out.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("mr").alias("mr_bar"), F.avg("ewma").alias("ewma_mean"), F.max("ewma_ucl").alias("ewma_ucl"), *(F.count_if(c).alias(c) for c in ("r1", "r2", "r3", "r4"))), 4)


def spc_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: limits frozen on the first 80 %, rates in phase I, phase II and the last 5 %."""
    rows, n = placed_events(spark, sf_dir)
    return rounded(spc.screening(rows, "event_type", "x", ORDER, F.col("pos") >= n * 4 // 5, F.col("pos") >= n * 19 // 20))


def windowed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = placed_events(spark, sf_dir)
    return rounded(spc.windowed_rate(rows, "pos", F.col("event_type") == "error", 50))


def pchart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = placed_events(spark, sf_dir)
    return rounded(spc.p_chart(rows, "pos", F.col("event_type") == "error", F.col("pos") < n * 4 // 5))


def protocol_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = placed_events(spark, sf_dir)
    rows = rows.withColumns({"f_null": F.col("x").isNull().cast("int"), "f_high": F.coalesce(F.col("x") > 100, F.lit(False)).cast("int")})
    return rounded(spc.protocol_charts(rows, "pos", ["f_null", "f_high"], F.col("pos") < n * 4 // 5))


def drift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.drift_table(spc_screening(spark, sf_dir), -1.0).select("event_type", "delta")


def queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return rounded(artifacts.queue_view(o, "o_orderkey", 20))


def showcase_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 1000).alias("delta"), (F.count(F.lit(1)) % 2 == 0).alias("stable"))
    return rounded(spc.showcase(users, "user_id"))


def stable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(spc.stable_set(users, "user_id", "n"))


def _queue(spark: SparkSession, sf_dir: str, month: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.date_format("o_orderdate", "yyyy-MM") == month)
    p = F.col("o_totalprice") / 1e6
    scores = o.select(F.col("o_orderkey").alias("wafer_id"), F.col("o_orderdate").alias("timestamp"), p.alias("score_raw"), F.when(F.col("o_orderkey") % 3 != 0, p / 2).alias("p_cal"), (F.col("o_orderstatus") == "F").cast("int").alias("fail"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("flag"))
    return monitoring.score_queue(scores, "wafer_id", "timestamp").withColumn("p", F.coalesce("p_cal", "score_raw"))


def score_rank_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_queue(spark, sf_dir, "1996-01").select("wafer_id", "p", "rank", "decile"))


def inspection_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.inspection_queue(_queue(spark, sf_dir, "1996-01"), 25).select("rank", "wafer_id", "in_top_k")


def scorecard_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.scorecard(_queue(spark, sf_dir, "1996-01"), "p", "fail", "flag"))


def scorecard_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (monitoring.scorecard(_queue(spark, sf_dir, m), "p", "fail", "flag") for m in ("1996-01", "1996-02"))
    return rounded(monitoring.scorecard_delta(two, one).select("d_p_median", "d_p_mean", "d_p90", "d_capture"))


def reconcile_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    copy = o.where("o_orderkey % 100 != 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 0.5).otherwise(0.0))
    return rounded(monitoring.reconcile_keyed(o, copy, "o_orderkey", "o_totalprice", "o_totalprice"))


def reconcile_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    return rounded(monitoring.reconcile_sorted(o, o.withColumn("o_totalprice", F.col("o_totalprice") + 0.25), "o_totalprice", "o_totalprice"))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_events(spark, sf_dir).withColumn("week", F.weekofyear("ts").cast("long"))


def output_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.output_health(_weeks(spark, sf_dir), F.when(F.col("x").isNotNull(), F.least(F.col("x") / 500, F.lit(1.0))), ["week"]))


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.control_limits(_weeks(spark, sf_dir).where("week = 1"), "event_type", "x", ORDER)


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.feature_drift(_weeks(spark, sf_dir), _limits(spark, sf_dir), "event_type", "x", ORDER, ["week"]))


def monitor_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weeks(spark, sf_dir)
    drift = monitoring.feature_drift(rows, _limits(spark, sf_dir), "event_type", "x", ORDER, ["week"])
    health = monitoring.output_health(rows, F.when(F.col("x").isNotNull(), F.least(F.col("x") / 500, F.lit(1.0))), ["week"])
    return rounded(monitoring.monitor_verdict(health, drift, ["week"]).select("week", "n_features", "drift_fraction", "verdict"))


def retrain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _weeks(spark, sf_dir).groupBy("week").agg((F.avg("x") / 1000).alias("max_delta")).select(F.concat(F.lit("run"), F.lpad(F.col("week").cast("string"), 3, "0")).alias("run_id"), "max_delta")
    return monitoring.retrain_policy(ledger, "run_id", consecutive=2, threshold=0.05).select("action", "metric", "n_records", F.array_join("evidence", ",").alias("evidence"))


def reconcile_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against keyless ones in another order: values match, positions do not."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    other = rows.select((-F.col("o_orderkey")).alias("line"), F.col("p").alias("q"))
    return rounded(monitoring.reconcile(rows, other, "p", "q", "o_orderkey", "o_orderkey", "line"), 4)


QUERIES = {f.__name__: f for f in (moving_range, spc_limits_robust, spc_limits_classic, ewma, we_rules, imr_series, spc_screening, windowed_rate, pchart, protocol_charts, drift_table, queue_view, showcase_pick, stable_set, score_rank_decile, inspection_queue, scorecard_panel, scorecard_delta, reconcile_keyed, reconcile_sorted, reconcile_chain, output_health, feature_drift, monitor_verdict, retrain_policy)}


def _limits_sql(source: str, method: str = "robust") -> str:
    """CTEs obs, c and lim from `source` (event_type, ts, event_id, x)."""
    center = "median" if method == "robust" else "mean"
    sigma = "1.4826 * mad" if method == "robust" else "mr_bar / 1.128"
    return f"""obs AS (SELECT event_type, x, abs(x - lag(x) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS mr FROM {source} WHERE x IS NOT NULL),
        c0 AS (SELECT event_type, count(*) AS n, median(x) AS median, avg(x) AS mean, avg(mr) AS mr_bar FROM obs GROUP BY 1),
        c1 AS (SELECT event_type, median(abs(x - c0.median)) AS mad FROM obs JOIN c0 USING (event_type) GROUP BY 1),
        c2 AS (SELECT event_type, n, {center} AS center, {sigma} AS sigma, mr_bar FROM c0 JOIN c1 USING (event_type)),
        lim AS (SELECT event_type, CASE WHEN ok THEN center END AS center, CASE WHEN ok THEN sigma END AS sigma, CASE WHEN ok THEN center - 3 * sigma END AS lcl, CASE WHEN ok THEN center + 3 * sigma END AS ucl,
            CASE WHEN ok THEN mr_bar END AS mr_bar, CASE WHEN ok THEN 3.267 * mr_bar END AS mr_ucl, NOT ok AS degenerate FROM (SELECT *, n >= 25 AND sigma > 0 AS ok FROM c2))"""


_P1 = "p1 AS (SELECT e.* FROM e, n WHERE pos < n * 4 // 5)"
_SHOW = "SELECT event_type, round(center, 6) AS center, round(sigma, 6) AS sigma, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl, round(mr_bar, 6) AS mr_bar, round(mr_ucl, 6) AS mr_ucl, degenerate FROM lim"


def _ewma_sql(source: str, seed: str) -> str:
    """CTE z: ewma by the closed form; 0.8^-n stays in range for the few thousand rows a sensor has at test size."""
    return f"""z0 AS (SELECT *, count(x) OVER w AS k FROM {source} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        z AS (SELECT *, pow(0.8::DOUBLE, k) * ({seed}) + coalesce(sum(0.2 * x * pow(0.8::DOUBLE, -k)) OVER w, 0) * pow(0.8::DOUBLE, k) AS ewma FROM z0 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


_WE = """w0 AS (SELECT *, coalesce(abs(s) > 3, false) AS r1,
        coalesce((s > 2 AND sum((s > 2)::INT) OVER w3 >= 2) OR (-s > 2 AND sum((-s > 2)::INT) OVER w3 >= 2), false) AS r2,
        coalesce((s > 1 AND sum((s > 1)::INT) OVER w5 >= 4) OR (-s > 1 AND sum((-s > 1)::INT) OVER w5 >= 4), false) AS r3,
        coalesce((s > 0 AND sum((s > 0)::INT) OVER w8 >= 8) OR (-s > 0 AND sum((-s > 0)::INT) OVER w8 >= 8), false) AS r4 FROM {source}
    WINDOW w3 AS ({part} ORDER BY ts, event_id ROWS 2 PRECEDING), w5 AS ({part} ORDER BY ts, event_id ROWS 4 PRECEDING), w8 AS ({part} ORDER BY ts, event_id ROWS 7 PRECEDING))"""
_BY_TYPE = "PARTITION BY event_type"
_WEEK = "wk AS (SELECT *, weekofyear(ts)::BIGINT AS week FROM e)"
_HEALTH = "h AS (SELECT week, count(*) AS n, avg(p) AS m, stddev_pop(p) AS s, avg((p >= 0.15)::INT) AS t, avg(-(q * log2(q) + (1 - q) * log2(1 - q))) AS en FROM (SELECT week, p, greatest(least(p, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM (SELECT week, least(x / 500, 1) AS p FROM wk WHERE x IS NOT NULL)) GROUP BY 1)"
_DRIFT = "wk1 AS (SELECT * FROM wk WHERE week = 1), " + _limits_sql("wk1") + ", sz AS (SELECT wk.*, (x - center) / sigma AS s FROM wk JOIN lim USING (event_type) WHERE x IS NOT NULL AND NOT degenerate), " + _WE.format(source="sz", part="PARTITION BY week, event_type") + """,
    dr AS (SELECT week, event_type, count(*) AS n, max(abs(s)) AS mz, avg((abs(s) > 2)::INT) AS b, bool_or(r1) AS r FROM w0 GROUP BY ALL), df AS (SELECT *, r OR mz > 3 OR b >= 0.4 AS drifted FROM dr)"""


def _queue_sql(month: str, name: str = "q") -> str:
    return f"""{name}0 AS (SELECT o_orderkey AS wafer_id, o_orderdate AS ts, coalesce(CASE WHEN o_orderkey % 3 != 0 THEN o_totalprice / 1e6 / 2 END, o_totalprice / 1e6) AS p, (o_orderstatus = 'F')::INT AS fail, (o_orderkey % 5 = 0)::INT AS flag FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{month}'),
        {name} AS (SELECT *, row_number() OVER (ORDER BY p DESC, ts, wafer_id) AS rank, ((row_number() OVER (ORDER BY p DESC, ts, wafer_id) - 1) * 10 // count(*) OVER () + 1)::BIGINT AS decile FROM {name}0)"""


def _panel_sql(name: str) -> str:
    return f"""SELECT count(*) AS n, median(p) AS p_median, avg(p) AS p_mean, quantile_cont(p, 0.9) AS p90, count(fail) AS n_labelled, sum(fail)::BIGINT AS n_fail, count(*) FILTER (decile = 1) AS n_top, sum(fail) FILTER (decile = 1)::BIGINT AS top_fails,
        avg(flag) AS flag_share, avg(flag) FILTER (decile = 1) AS top_flag_share FROM {name}"""


ORACLE_SQL = {
    "moving_range": f"WITH {EVENTS_SQL} SELECT event_id, round(abs(x - lag(x) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS mr FROM e",
    "spc_limits_robust": f"WITH {EVENTS_SQL}, {_P1}, {_limits_sql('p1')} {_SHOW}",
    "spc_limits_classic": f"WITH {EVENTS_SQL}, {_P1}, {_limits_sql('p1', 'classic')} {_SHOW}",
    "ewma": f"WITH {EVENTS_SQL}, {_ewma_sql('e', '50')} SELECT event_id, round(ewma, 4) AS ewma FROM z",
    "we_rules": f"WITH {EVENTS_SQL}, sz AS (SELECT *, (x - 50) / 25 AS s FROM e), {_WE.format(source='sz', part=_BY_TYPE)} SELECT event_id, r1, r2, r3, r4 FROM w0",
    "imr_series": f"""WITH {EVENTS_SQL}, {_limits_sql('e')}, j AS (SELECT e.*, center, sigma, abs(x - lag(x) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS m FROM e JOIN lim USING (event_type)), {_ewma_sql('j', 'center')},
        sz AS (SELECT *, (x - center) / sigma AS s FROM z), {_WE.format(source='sz', part=_BY_TYPE)}
        SELECT event_type, count(x) AS n, round(avg(m), 4) AS mr_bar, round(avg(ewma), 4) AS ewma_mean, round(max(center + 3 * sigma * sqrt(0.2 / 1.8)), 4) AS ewma_ucl, count(*) FILTER (r1) AS r1, count(*) FILTER (r2) AS r2, count(*) FILTER (r3) AS r3, count(*) FILTER (r4) AS r4 FROM w0 GROUP BY 1""",
    "spc_screening": f"""WITH {EVENTS_SQL}, {_P1}, {_limits_sql('p1')}, j AS (SELECT e.*, lim.* EXCLUDE (event_type), pos >= n * 4 // 5 AS p2, pos >= n * 19 // 20 AS tail FROM e JOIN lim USING (event_type), n), {_ewma_sql('j', 'center')},
        f AS (SELECT *, (x < lcl OR x > ucl)::INT AS o, (abs(ewma - center) > 3 * sigma * sqrt(0.2 / 1.8))::INT AS a, (x IS NULL)::INT AS m FROM z),
        s AS (SELECT event_type, bool_or(degenerate) AS degenerate, {', '.join(f"avg({c}) FILTER ({p}) AS {n}_{q}" for q, p in (('p1', 'NOT p2'), ('p2', 'p2'), ('tail', 'tail')) for n, c in (('ooc', 'o'), ('ewma', 'a'), ('miss', 'm')))} FROM f GROUP BY 1)
        SELECT event_type, degenerate, {', '.join(f"round({n}_{q}, 6) AS {n}_{q}" for q in ('p1', 'p2', 'tail') for n in ('ooc', 'ewma', 'miss'))}, round(ooc_p2 - ooc_p1, 6) + 0.0 AS delta, round(ewma_p2 - ewma_p1, 6) + 0.0 AS ewma_delta FROM s""",
    "windowed_rate": f"WITH {EVENTS_SQL} SELECT pos // 50 AS w, max(pos) + 1 AS x, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS rate FROM e GROUP BY 1",
    "pchart": f"""WITH {EVENTS_SQL}, p AS (SELECT avg((event_type = 'error')::INT) AS p0 FROM e, n WHERE pos < n * 4 // 5), g AS (SELECT pos // 50 AS w, max(pos) + 1 AS x, count(*) AS n, avg((event_type = 'error')::INT) AS rate FROM e GROUP BY 1)
        SELECT w, x, n, round(rate, 6) AS rate, round(p0, 6) AS p0, round(greatest(p0 - 3 * sqrt(p0 * (1 - p0) / n), 0), 6) + 0.0 AS lcl, round(p0 + 3 * sqrt(p0 * (1 - p0) / n), 6) AS ucl, rate > p0 + 3 * sqrt(p0 * (1 - p0) / n) AS alarm FROM g, p""",
    "showcase_pick": """WITH u AS (SELECT user_id, avg(value) / 1000 AS delta, count(*) % 2 = 0 AS stable FROM events GROUP BY 1), c AS (SELECT *, CASE WHEN stable AND delta >= 0.05 THEN 0 WHEN stable THEN 1 WHEN delta >= 0.05 THEN 2 ELSE 3 END AS cell FROM u),
        k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN cell = 1 THEN delta ELSE -delta END, user_id) AS place FROM c)
        SELECT user_id, round(delta, 6) AS delta, stable, cell::BIGINT AS cell, place FROM k WHERE place <= CASE cell WHEN 0 THEN 4 WHEN 3 THEN 0 ELSE 2 END""",
    "stable_set": "SELECT user_id, round(count(*) / (CASE WHEN max(count(*)) OVER () > 1.5 THEN max(count(*)) OVER () ELSE 1 END)::DOUBLE, 6) AS stability FROM events GROUP BY 1",
    "score_rank_decile": f"WITH {_queue_sql('1996-01')} SELECT wafer_id, round(p, 6) AS p, rank, decile FROM q",
    "inspection_queue": f"WITH {_queue_sql('1996-01')} SELECT rank, wafer_id, true AS in_top_k FROM q WHERE rank <= 25",
    "scorecard_panel": f"""WITH {_queue_sql('1996-01')}, p AS ({_panel_sql('q')}) SELECT n, round(p_median, 6) AS p_median, round(p_mean, 6) AS p_mean, round(p90, 6) AS p90, n_labelled, n_fail, n_top, top_fails, round(flag_share, 6) AS flag_share, round(top_flag_share, 6) AS top_flag_share,
        round(CASE WHEN n_fail > 0 THEN top_fails / n_fail::DOUBLE END, 6) AS capture, round(CASE WHEN n_fail > 0 THEN top_fails / n_top::DOUBLE / (n_fail / n::DOUBLE) END, 6) AS lift, round(top_flag_share / flag_share, 6) AS enrichment FROM p""",
    "scorecard_delta": f"""WITH {_queue_sql('1996-01', 'a')}, {_queue_sql('1996-02', 'b')}, x AS ({_panel_sql('a')}), y AS ({_panel_sql('b')})
        SELECT round(y.p_median - x.p_median, 6) AS d_p_median, round(y.p_mean - x.p_mean, 6) AS d_p_mean, round(y.p90 - x.p90, 6) AS d_p90,
            round((CASE WHEN y.n_fail > 0 THEN y.top_fails / y.n_fail::DOUBLE END) - (CASE WHEN x.n_fail > 0 THEN x.top_fails / x.n_fail::DOUBLE END), 6) AS d_capture FROM x, y""",
    "reconcile_keyed": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 100 != 0) AS m, max(CASE WHEN o_orderkey % 100 != 0 AND o_orderkey % 7 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS d FROM orders) SELECT n, m AS n_reference, m AS n_matched, d AS max_abs_diff, CASE WHEN m != n THEN 'fail_key_coverage' WHEN d < 1e-6 THEN 'pass' ELSE 'fail_values' END AS verdict FROM c",
    "reconcile_chain": """WITH a AS (SELECT o_totalprice AS p, row_number() OVER (ORDER BY o_orderkey) AS k, row_number() OVER (ORDER BY o_orderkey DESC) AS l FROM orders), d AS (SELECT max(abs(x.p - y.p)) AS d, count(*) AS n FROM a x JOIN a y ON x.k = y.l)
        SELECT n, n AS n_reference, round(d, 4) AS positional_max_abs_diff, 0.0::DOUBLE AS sorted_max_abs_diff, CASE WHEN d < 1e-6 THEN 'pass' ELSE 'pass_values_only' END AS verdict FROM d""",
    "reconcile_sorted": "SELECT count(*) AS n, count(*) AS n_reference, 0.25::DOUBLE AS max_abs_diff, 'fail_values' AS verdict FROM orders",
    "output_health": f"WITH {EVENTS_SQL}, {_WEEK}, {_HEALTH} SELECT week, n, round(m, 4) AS mean_risk, round(s, 4) AS std_risk, round(t, 4) AS triage_rate, round(en, 4) AS mean_entropy, t >= 0.2 AS risk_ooc FROM h",
    "feature_drift": f"WITH {EVENTS_SQL}, {_WEEK}, {_DRIFT} SELECT week, event_type, n, round(mz, 2) AS max_z, round(b, 6) AS beyond_2s, r AS any_r1, drifted FROM df",
    "monitor_verdict": f"""WITH {EVENTS_SQL}, {_WEEK}, {_HEALTH}, {_DRIFT}, fr AS (SELECT week, count(*) AS k, avg(drifted::INT) AS f FROM df GROUP BY 1)
        SELECT week, coalesce(k, 0)::BIGINT AS n_features, round(coalesce(f, 0), 6) + 0.0 AS drift_fraction, CASE WHEN t >= 0.2 THEN 'RETRAIN' WHEN coalesce(f, 0) >= 0.25 THEN 'INVESTIGATE' ELSE 'IN_CONTROL' END AS verdict FROM h LEFT JOIN fr USING (week)""",
    "retrain_policy": f"""WITH {EVENTS_SQL}, {_WEEK}, l AS (SELECT 'run' || lpad(week::VARCHAR, 3, '0') AS id, avg(x) / 1000 AS v FROM wk GROUP BY 1), k AS (SELECT * FROM l WHERE v IS NOT NULL ORDER BY id DESC LIMIT 2)
        SELECT CASE WHEN count(*) >= 2 AND min(v) >= 0.05 THEN 'RETRAIN_RECOMMENDED' ELSE 'IN_CONTROL' END AS action, 'max_delta' AS metric, count(*) AS n_records, string_agg(id, ',' ORDER BY id DESC) AS evidence FROM k""",
}
ORACLE_SQL |= {
    "protocol_charts": f"""WITH {EVENTS_SQL}, f AS (SELECT pos, 'f_null' AS feature, (x IS NULL)::INT AS v FROM e UNION ALL SELECT pos, 'f_high', coalesce(x > 100, false)::INT FROM e), p AS (SELECT feature, avg(v) AS p0 FROM f, n WHERE pos < n * 4 // 5 GROUP BY 1),
        g AS (SELECT feature, pos // 50 AS w, max(pos) + 1 AS x, count(*) AS n, avg(v) AS rate FROM f GROUP BY ALL)
        SELECT feature, w, x, n, round(rate, 6) AS rate, round(p0, 6) AS p0, round(greatest(p0 - 3 * sqrt(p0 * (1 - p0) / n), 0), 6) + 0.0 AS lcl, round(p0 + 3 * sqrt(p0 * (1 - p0) / n), 6) AS ucl, rate > p0 + 3 * sqrt(p0 * (1 - p0) / n) AS alarm FROM g JOIN p USING (feature)""",
    "drift_table": "SELECT event_type, delta FROM (" + ORACLE_SQL["spc_screening"] + ") WHERE delta IS NOT NULL AND delta >= -1",
    "queue_view": "SELECT o_orderkey, round(o_totalprice, 6) AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, true AS in_top_k FROM orders QUALIFY rank <= 20",
}
