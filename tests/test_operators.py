import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldspark.functions.nulls import nan_to_null, to_number
from yieldspark.operators import doe, eda, extract, features, quality, timeseries
from yieldspark.sources import readers, registry


def test_nan_is_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, k int"))
    assert df.agg(F.count("x"), F.avg("x")).first()[:] == (1, 1.0)
    got = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("inf",)], "s string").select(to_number(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == [1.5, None, None, None]


def test_split_order(spark):
    df = spark.createDataFrame([(f"2008-10-0{d} 00:00:00",) for d in range(1, 6)], "t string").select(F.to_timestamp("t").alias("t"))
    zone = lambda c, x: [r[0] for r in df.orderBy("t").select(extract.split_zone(F.col("t"), c, x)).collect()]
    assert zone("2008-10-02", "2008-10-04") == ["cv", "holdout", "holdout", "excluded", "excluded"]
    assert zone(None, None) == ["unassigned"] * 5
    assert zone(None, "2008-10-05") == ["unassigned"] * 4 + ["excluded"]
    with pytest.raises(ValueError):
        extract.refuse_collisions(df, "t", "2008-10-02", None)


def test_missingness(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (1.0, 2.0, 3.0), (None, None, None)], "a double, b double, c double")
    got = features.missingness_features(df, {"f": ["a", "b"]}, ["a", "b", "c"]).select("f", "f_row_missing_rate").collect()
    assert sorted((r[0], round(r[1], 4)) for r in got) == [(0, 0.0), (1, 0.3333), (1, 1.0)]
    found = features.schema_violations(df, {"a": "double", "z": "string"}, ["b"])
    assert "z: missing" in found and "a: 1 null" in found and "a: 1 repeated" in found
    with pytest.raises(ValueError):
        features.recode_target(spark.createDataFrame([(1, 0)], "target int, is_fail int"))


def test_quality_rules(spark):
    rng = np.random.default_rng(0)
    n = 400
    rows = pd.DataFrame({"good": rng.normal(10, 3, n), "constant": 1.0, "gone": [1.0 + i if i < 100 else None for i in range(n)], "flat": [0.0] * 398 + [1.0, 2.0], "rescued": [0.0] * 398 + [1.0] * 2, "y": 0})
    rows["empty"] = np.nan
    rows.loc[393:, "rescued"] = np.arange(7) + 1.0
    rows.loc[393:, "y"] = 1
    df = nan_to_null(spark.createDataFrame(rows))
    got = {r["column_name"]: r["verdict"] for r in quality.verdicts(quality.column_quality(df, ["good", "constant", "gone", "flat", "rescued", "empty"], "y")).collect()}
    assert got == {"good": "keep", "constant": "constant", "gone": "missing", "flat": "near_zero_variance", "rescued": "keep", "empty": "missing"}


def test_pairwise_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.normal(size=(300, 4)) + 1000, columns=list("abcd"))
    x["d"] = x["a"] * 2 + rng.normal(size=300) * 0.01
    x = x.mask(rng.random(x.shape) < 0.2)
    got = quality.pairwise_correlation(nan_to_null(spark.createDataFrame(x)), list("abcd"))
    want = x.corr()
    for r in got.collect():
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-9)
    assert quality.prune_correlated(got, {"a": 0.3, "d": 0.1}) == ["a"]
    assert quality.prune_correlated(got, {}) == ["a"]
    assert quality.prune_correlated(got, {"a": 0.1, "d": 0.3}) == ["d"]


def test_hedges_and_selection(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a + y), 1.0, int(y)) for a, y in zip(rng.normal(size=200), rng.random(200) < 0.3, strict=True)], "a double, k double, y int")
    got = {r["column_name"]: r["g"] for r in quality.hedges_g(df, ["a", "k"], "y").collect()}
    assert got["k"] == 0.0 and 0.5 < got["a"] < 1.6
    effects = spark.createDataFrame([(f"s{i}", i / 100) for i in range(50)], "column_name string, g double")
    assert quality.select_features(effects).count() == 25
    assert quality.select_features(effects, g_min=0.45).count() == 30
    assert quality.select_features(effects, k_max=20).count() == 20


def test_factorial_design(spark):
    f = [{"name": "temp", "low": 10, "high": 20}, {"name": "flow", "low": -1, "high": 1}]
    d = doe.factorial_design(spark, f, replicates=2, centers=2, seed=1337)
    assert d.count() == 10 and d.where("is_center").select("temp").first()[0] == 15
    assert [r["temp_coded"] for r in d.orderBy("design_row").limit(4).collect()] == [-1, 1, -1, 1]
    assert d.select("run_order").collect() == doe.factorial_design(spark, f, 2, 2, seed=1337).select("run_order").collect()
    with pytest.raises(ValueError):
        doe.coded_design(["a", "b"], "a b ab")


def test_effects_recovered(spark):
    rows = []
    for k, (a, b) in enumerate([(-1, -1), (1, -1), (-1, 1), (1, 1), (0, 0)]):
        rows += [(f"doe_{k + 1:03d}", a, b, 0.15 + 0.3 * (a + 1) / 2 + 0.1 * (b + 1) / 2 + 0.15 * (a + 1) * (b + 1) / 4 + 0.001 * w) for w in range(5)]
    cells = doe.cell_summary(spark.createDataFrame(rows, "run_id string, a int, b int, p double"), ["run_id", "a", "b"], "p").withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})
    fit = {r["term"]: r["estimate"] for r in doe.ols_effects(cells.where("a != 0"), ["a", "b"]).collect()}
    assert fit["a"] == pytest.approx(0.1875) and fit["a:b"] == pytest.approx(0.0375)
    main = {r["factor"]: r["effect"] for r in doe.main_effects(cells, ["a", "b"]).collect()}
    assert main["a"] == pytest.approx(0.375)
    assert doe.recommend(cells, "run_id").first()["run_id"] == "doe_001"
    assert doe.curvature(cells, F.col("a") == 0).first()["n_center"] == 1


def test_glm(spark):
    cells = spark.createDataFrame([(-1.0, -1.0, 20, 100), (1.0, -1.0, 60, 100), (-1.0, 1.0, 22, 100), (1.0, 1.0, 62, 100)], "a double, b double, failures long, trials long")
    fit = {r["term"]: r for r in doe.glm_effects(cells, ["a", "b"]).collect()}
    logit = lambda p: math.log(p / (1 - p))
    want = (logit(0.6) + logit(0.62) - logit(0.2) - logit(0.22)) / 4
    assert fit["a"]["estimate"] == pytest.approx(want, abs=1e-6) and fit["a"]["odds_ratio"] == pytest.approx(math.exp(want), abs=1e-5)


def test_ood_needs_background(spark):
    rng = np.random.default_rng(4)
    bg = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))], "wafer_id long, a double, b double")
    design = spark.createDataFrame([("in", 0.0, 0.0), ("out", 9.0, 9.0)], "run_id string, a double, b double")
    got = {r["run_id"]: r["ood_flag"] for r in doe.ood_table(design, bg, ["a", "b"]).collect()}
    assert got == {"in": False, "out": True}
    with pytest.raises(ValueError):
        doe.ood_table(design, bg.limit(10), ["a", "b"])


def test_windows_and_days(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "pos long, v double")
    mean = lambda s: [r["mean"] for r in timeseries.windowed_mean(df, "pos", "v", 4, s).orderBy("w").collect()]
    assert mean(0) == [1.5, 5.5, 8.5] and mean(2) == [3.5, 7.5]
    days = spark.createDataFrame([("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-03", 1)], "t string, y int").withColumn("t", F.to_timestamp("t"))
    got = timeseries.daily_grid(days, "t", "y").orderBy("day").collect()
    assert [(r["n"], r["total_fail"], r["fail_freq"]) for r in got] == [(2, 1, 0.5), (0, 0, None), (1, 1, 1.0)]


def test_rolling_origin(spark):
    flat = [("flat", i, 0.07) for i in range(30)] + [("ramp", i, float(i)) for i in range(30)]
    got = {(r["k"], r["model"]): r for r in timeseries.rolling_origin(spark.createDataFrame(flat, "k string, t int, y double"), "k", "t", "y").collect()}
    assert got["flat", "persistence"]["mae"] == 0 and got["flat", "persistence"]["mase"] is None
    assert got["ramp", "persistence"]["mae"] == 1.5


def test_arima_likelihood_golden():
    # A long series of known parameters; likelihoods against dense algebra (published values: test_golden.py).
    rng = np.random.default_rng(8)
    e = rng.normal(size=400)
    y = np.cumsum(e - 0.6 * np.append(0, e[:-1]))
    fit = timeseries.fit_arima(y, (0, 1, 1))
    assert fit["ma"][0] == pytest.approx(-0.6, abs=0.1) and fit["sigma2"] == pytest.approx(1, abs=0.2)
    z = np.array([0.3, -0.2, 0.5])
    theta = 0.4
    cov = np.diag([1 + theta**2] * 3) + np.diag([theta] * 2, 1) + np.diag([theta] * 2, -1)
    s2 = z @ np.linalg.solve(cov, z) / 3
    want = -0.5 * (3 * np.log(2 * np.pi * s2) + np.linalg.slogdet(cov)[1] + 3)
    assert timeseries.kalman(z, np.zeros(0), np.array([theta]))[0] == pytest.approx(want)
    x = rng.normal(size=(120, 1))
    assert timeseries.fit_arima(0.07 - 0.5 * x[:, 0] + 0.01 * rng.normal(size=120), (1, 0, 0), exog=x)["beta"][1] == pytest.approx(-0.5, abs=0.02)


def test_breaches(spark):
    rows = spark.createDataFrame([("a", v, 5.0, 6.0) for v in (5.5, 5.6, 9.0, 5.4, 6.0)], "k string, actual double, lower double, upper double")
    got = timeseries.breach_summary(rows, ["k"]).first()
    assert got["n_breach"] == 1 and got["coverage"] == 0.8


def test_registry(spark):
    old = spark.createDataFrame([("s001", "feature_raw", "active", 1, 0.0, None, None), ("s002", "feature_raw", "active", 2, 0.0, None, None)], registry.REGISTRY)
    new = spark.createDataFrame([("s002", "feature_raw", "excluded"), ("f_x", "feature_eng", "active")], "column_name string, role string, status string")
    both = registry.upsert(old, new)
    assert registry.active_columns(both) == ["s001", "f_x"]
    assert registry.active_columns(registry.retire(both, ["s001"], "constant")) == ["f_x"]
    assert registry.append_fixed(new, old).columns == new.columns


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 3) for i in range(50)], "k long, x double")
    reg = spark.createDataFrame([("x", "feature_raw", "active", 1, 0.0, None, None)], registry.REGISTRY)
    one = registry.write_snapshot(df, str(tmp_path), reg)
    two = registry.write_snapshot(df.repartition(7), str(tmp_path), reg)
    assert one["snapshot_id"] == two["snapshot_id"]
    got, reg2, manifest = registry.read_snapshot(spark, str(tmp_path), one["snapshot_id"])
    assert got.exceptAll(df).isEmpty() and reg2.count() == 1 and manifest["n_rows"] == 50


def test_separated_text(spark, tmp_path):
    (tmp_path / "raw.data").write_text("1.5 NaN 3\n 4 5  6\n7 8 x\n")
    (tmp_path / "labels.data").write_text('-1 "19/07/2008 11:55:00"\n1 "bad"\n-1 "20/07/2008 01:00:00"\n')
    rows = readers.read_separated(spark, str(tmp_path / "raw.data"), 3)
    got = rows.orderBy("line").collect()
    assert [(r["line"], r["s001"], r["s002"], r["s003"]) for r in got] == [(0, 1.5, None, 3.0), (1, 4.0, 5.0, 6.0), (2, 7.0, 8.0, None)]
    labels = readers.read_labels(spark, str(tmp_path / "labels.data"))
    assert labels.where("timestamp is null").count() == 1
    with pytest.raises(ValueError, match="unparseable"):
        readers.shape_gate(rows, labels, 3, 3)
    assert readers.content_hashes(spark, str(tmp_path / "raw.data")).first()["sha256"]


def test_statistics(spark):
    rng = np.random.default_rng(6)
    x = pd.DataFrame({"a": rng.exponential(size=60).round(1), "y": rng.integers(0, 2, 60)})
    df = spark.createDataFrame(x)
    s = eda.shape_statistics(df, ["a"]).first()
    assert s["skew"] == pytest.approx(x["a"].skew()) and s["kurtosis"] == pytest.approx(x["a"].kurtosis())
    u = eda.mann_whitney(df, ["a"], "y").first()["u"]
    one, zero = x["a"][x["y"] == 1], x["a"][x["y"] == 0]
    assert u == sum((p > q) + 0.5 * (p == q) for p in one for q in zero)
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])], "k int, p double")
    q = {r["k"]: r["q"] for r in eda.benjamini_hochberg(tests, "k").collect()}
    assert [round(q[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.2]
    z = spark.createDataFrame([(1.96,), (0.0,), (4.0,)], "z double").select(eda.two_sided(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in z] == pytest.approx([0.0499958, 1.0, 6.334e-5], abs=2e-7)
    tea = spark.createDataFrame([(1, 3, 1, 1, 3)], "k int, a int, b int, c int, d int")
    assert eda.fisher_exact(tea, "k").first()["p"] == pytest.approx(0.485714, abs=1e-6)


def test_running_sums_within_keys(spark):
    from yieldspark.operators.ordering import running_sums

    rng = np.random.default_rng(11)
    x = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": rng.permutation(200), "v": rng.integers(0, 9, 200)})
    got = running_sums(spark.createDataFrame(x), [F.col("t")], {"s": F.col("v")}, ranges=6, keys=["k"]).toPandas().sort_values(["k", "t"])
    assert (got["s"] == got.groupby("k")["v"].cumsum()).all()


def test_fisher_tails():
    """Outward sums equal full enumeration; large margins need few terms."""
    import math

    from yieldspark.operators.eda import _two_sided

    def plain(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        ps = {x: math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(p for p in ps.values() if p <= ps[a] * (1 + 1e-7)) / math.comb(n, col)

    for t in [(3, 1, 1, 3), (0, 5, 7, 2), (10, 0, 0, 10), (5, 5, 5, 5), (1, 0, 0, 0), (0, 3, 0, 9), (200, 300, 310, 190), (17, 900, 3, 40)]:
        assert _two_sided(*t) == pytest.approx(plain(*t), rel=1e-6)
    assert _two_sided(0, 0, 0, 0) == 1.0 and 0 < _two_sided(5_000_000, 5_001_000, 5_000_500, 5_000_000) <= 1


def test_retrain_decision(spark, tmp_path):
    from yieldspark.operators import monitoring

    def of(text, **more):
        (tmp_path / "l.csv").write_text(text)
        got = monitoring.retrain_decision(spark, f"file://{tmp_path}/l.csv", **more)
        return got["verdict"], got["exit_code"]

    assert monitoring.retrain_decision(spark, f"file://{tmp_path}/none.csv")["verdict"] == "NO_DATA"
    assert of("") == ("EMPTY", 0) and of("run_id,max_delta\n") == ("EMPTY", 0)
    assert of("run_id,max_delta\na,0.01\nb,0.3\n") == ("RETRAIN_RECOMMENDED", 1)
    assert of("run_id,max_delta\na,0.01\nb,0.3\n", consecutive=2) == ("IN_CONTROL", 0)
    assert of("run_id,x\na,1\n") == ("NO_METRICS", 0) and of("run_id,max_delta\na,z\n") == ("NO_VALID_RECORDS", 0)
    assert of("max_delta\n0.3\n", order="run_id")[0] == "ERROR"


def test_reconcile_chain_and_summary(spark, tmp_path):
    from yieldspark.operators import monitoring
    from yieldspark.sources import artifacts

    a = spark.createDataFrame([(k, k / 10) for k in range(6)], "k long, p double")
    verdict = lambda ref, **more: monitoring.reconcile(a, ref, "p", "q", key="k", order="k", ref_order="line", **more).first()["verdict"]
    ref = lambda rows: spark.createDataFrame(rows, "line long, q double")
    assert verdict(ref([(k, k / 10) for k in range(6)])) == "pass"
    assert verdict(ref([(-k, k / 10) for k in range(6)])) == "pass_values_only"
    assert verdict(ref([(k, 0.5) for k in range(6)])) == "fail_values" and verdict(ref([(0, 0.0)])) == "fail_length"
    assert monitoring.reconcile(a, a.withColumnRenamed("p", "q"), "p", "q", key="k").first()["verdict"] == "pass"
    folder = f"file://{tmp_path}/run"
    artifacts.write_json(spark, {"n": 3}, f"{folder}/scorecard.json")
    assert artifacts.batch_summary(spark, folder) == {"scorecard": {"n": 3}, "reconciliation": {}}


@pytest.mark.parametrize("leaf", [1, 7, 4096])
def test_knn_in_leaves(spark, monkeypatch, leaf):
    """Exact over any leaves, with equal points, clusters and nulls."""
    monkeypatch.setattr(doe, "LEAF", leaf)
    rng = np.random.default_rng(4)
    ref = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(9, 0.1, (40, 2)), np.repeat([[3.0, 3.0]], 30, axis=0)]).round(2)
    ask = np.concatenate([rng.normal(2, 4, (20, 2)).round(2), [[3.0, 3.0], [100.0, -50.0]]])
    frame = lambda a: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(-1, None, 1.0)], "k long, a double, b double")
    got = {r["k"]: r["knn_distance"] for r in doe.knn_distance(frame(ask), frame(ref), "k", ["a", "b"], 5).collect()}
    want = {i: np.sort(np.sqrt(((ref - q) ** 2).sum(1)))[:5].mean() for i, q in enumerate(ask)}
    assert got == pytest.approx(want)
    few = doe.knn_distance(frame(ask), frame(ref[:3]), "k", ["a", "b"], 5).where("k = 0").first()["knn_distance"]
    assert few == pytest.approx(np.sqrt(((ref[:3] - ask[0]) ** 2).sum(1)).mean())
