"""Streamed hashes, ledger fingerprints, ordered files and the staged choice of a model."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.operators import timeseries
from yieldspark.sources import artifacts, readers


def test_hashes_of_files_in_pieces(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    files = {"a.txt": b"one\ntwo\n", "b.txt": b"one\ntwo", "c.bin": rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes(), "d.txt": b"", "e.txt": b"\n\n\r\n\r", "f.txt": b"x" * 5000, "g.txt": b"\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a file lies in many splits
    try:
        got = {r["path"].rpartition("/")[2]: (r["bytes"], r["sha256"]) for r in readers.content_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items() if c}


def test_data_fingerprint(spark):
    log = spark.createDataFrame([(1, "x", "old"), (2, "x", "new"), (3, "y", "other")], "ingest_id long, source_file string, source_sha256 string")
    got = readers.data_fingerprint(log, "SELECT 1").first()
    assert got["raw"] == {"x": "new", "y": "other"} and got["extract_sql_sha256"] == hashlib.sha256(b"SELECT 1").hexdigest()
    assert readers.data_fingerprint(log, "SELECT 1", files=1).first()["raw"] == {"y": "other"}
    assert readers.data_fingerprint(log.where("false"), "").first()["raw"] == {}


def test_ordered_files(spark, tmp_path):
    df = spark.range(500).select(F.pmod(F.hash("id"), F.lit(40)).alias("a"), "id").withColumn("a", F.when(F.col("a") > 2, F.col("a"))).repartition(7)
    path = f"file://{tmp_path}/o"
    manifest = artifacts.write_ordered(df, ["a", "id"], path, rows=60)
    files = artifacts.ordered_files(spark, path)
    assert len(files) == manifest.count() > 3
    seen = [tuple(r) for f in files for r in spark.read.parquet(f).collect()]
    assert seen == sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    (tmp_path / "o" / "data" / files[1].rpartition("/")[2]).unlink()
    with pytest.raises(ValueError, match="manifest"):
        artifacts.ordered_files(spark, path)


def test_staged_choice(spark):
    """A regressor with the expected sign is found and used; one of noise is not; short series give nulls."""
    rng = np.random.default_rng(4)
    x = rng.random(120)
    rows = [("sign", i, float(0.07 - 0.5 * x[i] + 0.01 * rng.normal()), float(x[i]), float(rng.random())) for i in range(120)]
    rows += [("noise", i, float(5 + rng.normal()), float(rng.random()), float(rng.random())) for i in range(60)]
    rows += [("short", i, 1.0, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, t long, y double, missing double, other double")
    got = {r["s"]: r for r in timeseries.staged_choice(df, "s", "t", "y", {"missing": -1, "other": 0}, 4, step=12).collect()}
    r = got["sign"]
    assert r["exog"] == "missing" and r["used"] and r["sign_ok"] and r["winner"] == "arima+missing"
    assert r["coefficient"] == pytest.approx(-0.5, abs=0.05) and r["p_value"] < 1e-6 and r["mase"] < 0.2 and r["holdout_mae"] < 0.05
    assert got["noise"]["winner"] in ("arima", f"arima+{got['noise']['exog']}") and got["noise"]["p_value"] > 1e-4
    assert got["short"]["p"] is None and not got["short"]["used"] and got["short"]["winner"] is None


def test_standard_errors_equal_least_squares():
    """With no ARMA terms the information matrix is that of a regression."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 1))
    y = 2 + 0.7 * x[:, 0] + rng.normal(size=80)
    fit = timeseries.fit_arima(y, (0, 0, 0), exog=x)
    d = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    s2 = ((y - d @ beta) ** 2).sum() / 80
    assert fit["beta"] == pytest.approx(beta, abs=1e-4) and fit["se_beta"] == pytest.approx(np.sqrt(np.diag(s2 * np.linalg.inv(d.T @ d))), rel=0.02)
