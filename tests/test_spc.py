import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.operators import eda, ordering, spc


def series(spark, values, sensor="s"):
    return spark.createDataFrame([(sensor, i, None if v is None else float(v)) for i, v in enumerate(values)], "sensor string, t long, x double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_moving_range_gaps(spark):
    df = spc.moving_range(series(spark, [1, 2, 4, 3, None, 5]), "x", ["sensor"], ["t"])
    assert column(df, "mr") == [None, 1, 2, 1, None, None]


def test_robust_limits_ignore_outliers(spark):
    x = np.random.default_rng(1).normal(size=1000)
    x[::20] = 50
    df = series(spark, x)
    robust = spc.control_limits(df, "sensor", "x", ["t"]).first()
    classic = spc.control_limits(df, "sensor", "x", ["t"], method="classic").first()
    assert 0.8 < robust["sigma"] < 1.5 and classic["sigma"] > 2 * robust["sigma"]
    assert robust["ucl"] == pytest.approx(robust["center"] + 3 * robust["sigma"])
    assert robust["mr_ucl"] == pytest.approx(3.267 * robust["mr_bar"])


def test_degenerate(spark):
    df = series(spark, [1.0] * 24, "few").union(series(spark, [1.0] * 40, "flat"))
    rows = {r["sensor"]: r for r in spc.control_limits(df, "sensor", "x", ["t"]).collect()}
    assert rows["few"]["degenerate"] and rows["flat"]["degenerate"] and rows["flat"]["sigma"] is None
    with pytest.raises(ValueError):
        spc.control_limits(df, "sensor", "x", ["t"], method="other")


def fold(values, seed, lam=0.2):
    out, z = [], seed
    for v in values:
        z = z if v is None else lam * v + (1 - lam) * z
        out.append(z)
    return out


@pytest.mark.parametrize("block", [3, 64, 100_000])
def test_ewma_blocks_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(spc, "BLOCK", block)
    rng = np.random.default_rng(block)
    values = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=300)]
    got = column(spc.ewma(series(spark, values), "sensor", "x", ["t"], F.lit(1.5)), "ewma")
    assert got == pytest.approx(fold(values, 1.5), abs=1e-9)


def test_ewma_step(spark):
    df = spc.ewma(series(spark, [0] * 50 + [2] * 50), "sensor", "x", ["t"], F.lit(0.0))
    z = column(df, "ewma")
    ucl = 3 * (0.2 / 1.8) ** 0.5
    assert z[-1] > ucl > z[25]


def rules(spark, z):
    df = spc.western_electric(series(spark, z), ["sensor"], ["t"], F.col("x"))
    return {r: [i for i, v in enumerate(column(df, r)) if v] for r in ("r1", "r2", "r3", "r4")}


def test_western_electric(spark):
    got = rules(spark, [0] * 10 + [4] + [0] * 10 + [0.5] * 8)
    assert got["r1"] == [10] and got["r4"] == [28]
    assert rules(spark, [0, 2.5, 0.1, 2.6])["r2"] == [3]
    assert rules(spark, [1.5, 1.5, 0, 1.5, 1.5])["r3"] == [4]
    assert rules(spark, [0.5] * 4 + [None] + [0.5] * 4)["r4"] == []
    assert rules(spark, [-0.5] * 8 + [0] + [-0.5] * 3)["r4"] == [7]


def test_hot_sensor_in_blocks(spark, monkeypatch):
    """Blocks led by the rows before them give what one window over the whole sensor gives."""
    rng = np.random.default_rng(4)
    values = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=200) * 1.5]
    df = series(spark, values, "hot").union(series(spark, values[:20], "small")).union(series(spark, values[50:70], None))
    names = ["sensor", "t", "mr", "r1", "r2", "r3", "r4", "rolling_mean"]

    def every():
        out = spc.western_electric(spc.moving_range(df, "x", ["sensor"], ["t"]), ["sensor"], ["t"], F.col("x"))
        return sorted(eda.rolling_mean(out, ["sensor"], ["t"], "x", 5).select(names).collect(), key=str)

    whole = every()
    monkeypatch.setattr(ordering, "RANGE_ROWS", 40)
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 16)
    blocks = every()
    assert len(blocks) == 240
    for a, b in zip(whole, blocks, strict=True):
        assert a[:-1] == b[:-1] and (a[-1] is None) == (b[-1] is None) and (a[-1] is None or a[-1] == pytest.approx(b[-1]))
    smoothed = spc.ewma(df.where("sensor = 'hot'"), "sensor", "x", ["t"], F.lit(0.5))
    assert column(smoothed, "ewma") == pytest.approx(fold(values, 0.5), abs=1e-9)


def test_screening_drift_and_empty_phase(spark):
    rng = np.random.default_rng(7)
    calm, drift = rng.normal(size=1567), rng.normal(size=1567)
    drift[1309:] += 2
    df = series(spark, calm, "calm").union(series(spark, drift, "drift"))
    rows = {r["sensor"]: r for r in spc.screening(df, "sensor", "x", ["t"], F.col("t") >= 1309, F.col("t") >= 1540).collect()}
    assert rows["drift"]["delta"] > 0.08 and rows["drift"]["ewma_delta"] > 0.5 and rows["calm"]["delta"] < 0.03
    none = spc.screening(series(spark, calm[:100]), "sensor", "x", ["t"], F.lit(False), F.lit(False)).first()
    assert none["ooc_p2"] is None and none["miss_tail"] is None and none["ooc_p1"] is not None


def test_pchart_limits(spark):
    from yieldspark.functions.stats import binomial_limits

    low, high = binomial_limits(F.lit(90 / 1309), F.col("n"))
    got = spark.createDataFrame([(50,), (17,)], "n int").select(low.alias("l"), high.alias("h")).collect()
    assert [round(r["h"], 6) for r in got] == [0.176109, 0.252866] and got[0]["l"] == 0.0


def test_partial_window_keeps_its_n(spark):
    df = series(spark, [1, 0, 1, 0, 0, 1, 1])
    got = spc.windowed_rate(df, "t", F.col("x") == 1, 3).orderBy("w").collect()
    assert [(r["x"], r["n"]) for r in got] == [(3, 3), (6, 3), (7, 1)] and got[2]["rate"] == 1.0


def test_showcase_top_up(spark):
    t = spark.createDataFrame([("a", 0.3, True), ("b", 0.01, True), ("c", 0.2, False), ("d", 0.04, False), ("e", 0.03, False), ("f", None, True)], "s string, delta double, stable boolean")
    assert {r["s"] for r in spc.showcase(t, "s", n=4).collect()} == {"a", "b", "c", "d"}
