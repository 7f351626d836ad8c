"""Time-series queries over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators import timeseries
from yieldspark.plans.tables import EVENTS_SQL, placed_events, rounded, table
from yieldspark.streaming import charts


def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("fail"))
    return rounded(timeseries.daily_grid(o, "o_orderdate", "fail"))


def windowed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = placed_events(spark, sf_dir)
    return rounded(timeseries.windowed_mean(rows, "pos", "x", 64, 10))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))


def naive_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.naive_scale(_daily(spark, sf_dir), "day", "y", ["event_type"]))


def baseline_rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.rolling_origin(_daily(spark, sf_dir), "event_type", "day", "y"))


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.autocorrelation(_daily(spark, sf_dir), "event_type", "day", "y", 5))


def arima_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.arima_grid(_daily(spark, sf_dir), "event_type", "day", "y"), 3)


def arima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.arima_forecast(_daily(spark, sf_dir), "event_type", "day", "y", 5), 3)


def forecast_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.breach_summary(timeseries.arima_forecast(_daily(spark, sf_dir), "event_type", "day", "y", 5), ["event_type"]))


def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.partial_autocorrelation(timeseries.autocorrelation(_daily(spark, sf_dir), "event_type", "day", "y", 2), "event_type"))


def seasonal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.seasonal_candidates(_daily(spark, sf_dir), "event_type", "day", "y"), 3)


def exogenous_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir).withColumns({"weekday": F.dayofweek("day").cast("double"), "half": (F.dayofmonth("day") > 15).cast("double")})
    return rounded(timeseries.exogenous_tests(daily, "event_type", "day", "y", ["weekday", "half"]).select("event_type", "exog", "coefficient", "accepted"), 1)


def staged_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, regressor, sign and winner of each daily series; the weekday is expected to have no sign."""
    daily = _daily(spark, sf_dir).withColumns({"weekday": F.dayofweek("day").cast("double"), "half": (F.dayofmonth("day") > 15).cast("double")})
    out = timeseries.staged_choice(daily, "event_type", "day", "y", {"weekday": 0, "half": 1}, holdout=4)
    return rounded(out.select("event_type", "p", "d", "q", "exog", "coefficient", "p_value", "sign_ok", "used", "winner", "mase"), 3)


def rolling_arima_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.rolling_arima_errors(_daily(spark, sf_dir), "event_type", "day", "y"), 3)


def channel_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.channel_drift(timeseries.arima_forecast(_daily(spark, sf_dir), "event_type", "day", "y", 5), "event_type"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the streaming p-chart, run as a batch."""
    out = charts.stream_p_chart(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", F.col("event_type") == "error", 0.2)
    return rounded(out)


QUERIES = {f.__name__: f for f in (daily_grid, windowed_mean, naive_scale, baseline_rolling_origin, autocorrelation, arima_grid, arima_forecast, forecast_breaches, partial_autocorrelation, seasonal_candidates, exogenous_tests, staged_choice, rolling_arima_errors, channel_drift, event_windows)}
_DAILY = "d AS (SELECT event_type, ts::DATE AS day, sum(value) AS y FROM events GROUP BY ALL)"
ORACLE_SQL = {
    "daily_grid": """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d)
        SELECT day, coalesce(n, 0) AS n, coalesce(f, 0) AS total_fail, round(f / n::DOUBLE, 6) AS fail_freq FROM s LEFT JOIN d USING (day)""",
    "windowed_mean": f"WITH {EVENTS_SQL} SELECT (pos - 10) // 64 AS w, count(*) AS n, round(avg(x), 6) AS mean FROM e WHERE pos >= 10 GROUP BY 1",
    "naive_scale": f"WITH {_DAILY} SELECT event_type, round(avg(s), 6) AS scale FROM (SELECT event_type, abs(y - lag(y) OVER (PARTITION BY event_type ORDER BY day)) AS s FROM d) GROUP BY 1",
    "baseline_rolling_origin": f"""WITH {_DAILY}, s AS (SELECT event_type, y, row_number() OVER w - 1 AS t, lag(y) OVER w AS last, avg(y) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean, count(*) OVER (PARTITION BY event_type) AS n FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
        o AS (SELECT * FROM s WHERE t >= 16 AND (t - 16) % 2 = 0 AND t <= n - 2), e AS (SELECT o.event_type, abs(a.y - o.last) AS p, abs(a.y - o.mean) AS m FROM o JOIN s a ON a.event_type = o.event_type AND a.t BETWEEN o.t AND o.t + 1),
        c AS (SELECT event_type, avg(abs(y - last)) AS scale FROM s GROUP BY 1), r AS (SELECT event_type, 'persistence' AS model, count(*) AS n, avg(p) AS mae FROM e GROUP BY 1 UNION ALL SELECT event_type, 'mean', count(*), avg(m) FROM e GROUP BY 1)
        SELECT event_type, model, n AS n_errors, round(mae, 6) AS mae, round(mae / scale, 6) AS mase FROM r JOIN c USING (event_type)""",
    "autocorrelation": f"WITH {_DAILY}, z AS (SELECT event_type, day, y - avg(y) OVER (PARTITION BY event_type) AS v FROM d), l AS (SELECT event_type, k AS lag, v, lag(v, k::INT) OVER (PARTITION BY event_type, k ORDER BY day) AS p FROM z, range(1, 6) t(k)) SELECT event_type, lag, round(sum(v * p) / sum(v * v), 6) + 0.0 AS acf FROM l GROUP BY ALL",
    "partial_autocorrelation": f"""WITH {_DAILY}, z AS (SELECT event_type, day, y - avg(y) OVER (PARTITION BY event_type) AS v FROM d), l AS (SELECT event_type, v, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2 FROM z WINDOW w AS (PARTITION BY event_type ORDER BY day)),
        r AS (SELECT event_type, sum(v * p1) / sum(v * v) AS r1, sum(v * p2) / sum(v * v) AS r2 FROM l GROUP BY 1) SELECT event_type, 1::BIGINT AS lag, round(r1, 6) + 0.0 AS pacf FROM r UNION ALL SELECT event_type, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) + 0.0 FROM r""",
    "event_windows": "WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, avg((event_type = 'error')::INT) AS rate FROM events GROUP BY 1) SELECT start, n, round(rate, 6) AS rate, round(greatest(0.2 - 3 * sqrt(0.16::DOUBLE / n), 0), 6) + 0.0 AS lcl, round(0.2 + 3 * sqrt(0.16::DOUBLE / n), 6) AS ucl, rate > 0.2 + 3 * sqrt(0.16::DOUBLE / n) AS alarm FROM w",
}
