"""Structured Streaming over lots as they land: deduplicated rows, tumbling p-charts, carried EWMA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from yieldspark.functions.stats import binomial_limits


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp of the session's zone, as watermarks need it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def fresh_rows(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a lot delivered twice is not scored twice."""
    return _timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_p_chart(stream: DataFrame, ts: str, flag: Column, p0: float, width: str = "1 day", late: str = "1 hour", k: float = 3.0) -> DataFrame:
    """start, n, rate, lcl, ucl, alarm of tumbling event-time windows under a frozen p0."""
    out = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))
    low, high = binomial_limits(F.lit(p0), F.col("n"), k)
    return out.select(F.col("window.start").alias("start"), "n", "rate", low.alias("lcl"), high.alias("ucl"), (F.col("rate") > high).alias("alarm"))


def stream_ewma(stream: DataFrame, sensor: str, order: str, value: str, seeds: dict[str, float], lam: float = 0.2) -> DataFrame:
    """sensor, n, ewma after each trigger: the state carries z across batches.

    Rows of one trigger are folded in the given order; a row that comes in a later trigger is folded after
    those of the earlier ones, whatever its order (stream_run_rules waits for late rows).
    """
    kind = dict(stream.dtypes)[sensor]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, n = state.get if state.exists else (seeds.get(str(key[0]), 0.0), 0)
        for x in pd.concat(list(parts)).sort_values(order)[value]:
            if x == x:
                z, n = lam * float(x) + (1 - lam) * z, n + 1
        state.update((z, n))
        yield pd.DataFrame({sensor: [key[0]], "n": [n], "ewma": [z]})

    rows = stream.select(sensor, order, F.col(value).cast("double").alias(value))
    return rows.groupBy(sensor).applyInPandasWithState(fold, f"{sensor} {kind}, n long, ewma double", "z double, n long", "update", GroupStateTimeout.NoTimeout)


def _rules(z: np.ndarray) -> dict[str, np.ndarray]:
    """r1..r4 of western_electric at each point of standardised values (NaN breaks runs)."""
    z = np.nan_to_num(z)

    def zone(limit: float, n: int, least: int) -> np.ndarray:
        out = np.zeros(len(z), bool)
        for side in (1, -1):
            beyond = side * z > limit
            upto = np.concatenate([np.zeros(n, int), beyond.cumsum()])
            out |= beyond & (upto[n:] - upto[:-n] >= least)
        return out

    return {"r1": np.abs(z) > 3, "r2": zone(2, 3, 2), "r3": zone(1, 5, 4), "r4": zone(0, 8, 8)}


def stream_run_rules(stream: DataFrame, sensor: str, ts: str, key: str, value: str, limits: DataFrame, late: str = "1 hour") -> DataFrame:
    """sensor, ts, key, z, r1..r4: the run rules at each row, as western_electric gives them in the order of ts and key.

    limits is a table of sensor, center, sigma; rows of other sensors are left out. A row is held until the
    watermark (the latest ts less `late`) has passed it, so rows may come in any order and in any number of
    triggers; what comes later than that is dropped. The state of a sensor is its last seven values and the
    rows that wait: memory is bounded by the rows of a sensor within `late`.
    """
    names = dict(stream.dtypes)
    frozen = limits.select(sensor, "center", "sigma")
    rows = _timed(stream, ts).withWatermark(ts, late).join(frozen, sensor)
    z = (F.col(value).cast("double") - F.col("center")) / F.col("sigma")
    rows = rows.select(sensor, ts, F.unix_micros(ts).alias("at"), F.col(key).cast("long").alias("key"), z.alias("z"))

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, at, keys, zs = map(list, state.get) if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            for p in parts:
                at += p["at"].tolist()
                keys += p["key"].tolist()
                zs += p["z"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(at)), key=lambda i: (at[i], keys[i]))
        ready, rest = [i for i in order if at[i] < mark], [i for i in order if at[i] >= mark]
        done = np.array(recent + [zs[i] for i in ready], float)
        flags = {n: f[len(recent) :] for n, f in _rules(done).items()}
        state.update((done[-7:].tolist(), [at[i] for i in rest], [keys[i] for i in rest], [zs[i] for i in rest]))
        if rest:
            state.setTimeoutTimestamp(max(at[rest[0]], mark) // 1000 + 1)
        yield pd.DataFrame({sensor: [group[0]] * len(ready), "at": [at[i] for i in ready], "key": [keys[i] for i in ready], "z": [zs[i] for i in ready]} | flags)

    out = rows.groupBy(sensor).applyInPandasWithState(
        fold,
        f"{sensor} {names[sensor]}, at long, key long, z double, r1 boolean, r2 boolean, r3 boolean, r4 boolean",
        "recent array<double>, at array<long>, keys array<long>, zs array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(sensor, F.timestamp_micros("at").alias(ts), F.col("key").alias(key), F.nanvl("z", F.lit(None)).alias("z"), "r1", "r2", "r3", "r4")
