"""Blocked moments, neighbour information, dropout groups and keyed draws against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.functions.draws import normal, uniform
from yieldspark.operators import doe, eda, moments, ordering, quality


def frame(spark, x, names, parts=4):
    return spark.createDataFrame([tuple([i, *(None if math.isnan(v) else float(v) for v in r)]) for i, r in enumerate(x)], "k long, " + ", ".join(f"{n} double" for n in names)).repartition(parts, "k")


@pytest.mark.parametrize("block", [2, 64])
def test_moments_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(moments, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5)) + 100
    whole = frame(spark, x, "abcde")
    n, mean, cov = moments.mean_and_covariance(whole, list("abcde"))
    assert n == 120 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    d = x - x.mean(0)
    want = np.sqrt(((d @ np.linalg.inv(np.cov(x.T))) * d).sum(1))
    got = doe.mahalanobis(whole, whole, list("abcde")).orderBy("k").toPandas()["mahalanobis"]
    assert np.allclose(got, want)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.0
    holes = frame(spark, x, "abcde")
    counts = {(r["i"], r["j"]): r["n"] for r in moments.known_pairs(holes, list("abcde")).collect()}
    assert counts == {(i, j): (~np.isnan(x[:, i]) & ~np.isnan(x[:, j])).sum() for i in range(5) for j in range(i, 5)}
    for r in quality.pairwise_correlation(holes, list("edcba")).collect():
        a, b = x[:, "abcde".index(r["a"])], x[:, "abcde".index(r["b"])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r["n"] == both.sum() and r["r"] == (None if r["b"] == "e" else pytest.approx(np.corrcoef(a[both], b[both])[0, 1]))
    assert moments.known_pairs(holes.where("false"), ["a", "b"]).count() == 0


def plain_information(x, y, k):
    keep = ~np.isnan(x) & np.array([v is not None for v in y])
    x, y = x[keep], np.array(y, object)[keep]
    sizes = {c: (y == c).sum() for c in set(y)}
    keep = np.array([sizes[c] > 1 for c in y], bool) if len(y) else np.zeros(0, bool)
    x, y = x[keep], y[keep]
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, n))
    terms = []
    for i in range(len(x)):
        own = np.sort(np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)[0]) - x[i]))
        kk = min(k, len(own))
        d = own[kk - 1]
        m = (x == x[i]).sum() if d == 0 else (np.abs(x - x[i]) < d).sum()
        terms.append(psi(kk) - psi(len(own) + 1) - psi(m))
    return len(x), max(0.0, psi(len(x)) + float(np.mean(terms))) if terms else None


@pytest.mark.parametrize("blocks", [None, 7])
def test_neighbour_information_with_ties_nulls_and_rare_classes(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(ordering, "RANGE_ROWS", 40)
        monkeypatch.setattr(ordering, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(2)
    y = [None if i % 29 == 0 else "rare" if i % 40 == 1 else "one" if i == 5 else "ab"[int(rng.random() < 0.4)] for i in range(160)]
    shift = np.array([{"a": 0.0, "b": 1.5}.get(c, 3.0) for c in y])
    x = np.stack([rng.normal(size=160) + shift, np.round(rng.normal(size=160) + shift), rng.normal(size=160), np.full(160, np.nan)], 1)
    x[::13, 0] = np.nan
    x[rng.random(160) < 0.3, 2] = 0.25
    df = frame(spark, x, "pqrs").join(spark.createDataFrame(list(enumerate(y)), "k long, y string"), "k")
    got = {r["column_name"]: (r["n"], r["mi"]) for r in eda.neighbour_information(df, list("pqrs"), "y", 4).collect()}
    want = {c: plain_information(x[:, j], y, 4) for j, c in enumerate("pqr")}
    assert got.keys() == want.keys() and all(got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1], abs=1e-9) for c in want)
    assert got["p"][1] > 0.2


def test_dropout_groups_of_nearly_equal_masks(spark):
    n = 4000
    null = np.zeros((n, 6), bool)
    null[: n // 4, :3] = True
    null[0, 1] = False  # one row apart
    null[:2, 2] = False  # linked through b only
    null[n // 2 :, 3] = True
    null[:, 5] = True
    df = frame(spark, np.where(null, np.nan, 1.0), "abcdef")
    got = {r["column_name"]: (r["n_missing"], r["group"], r["n_columns"]) for r in eda.dropout_groups(df, list("fedcba")).collect()}
    assert got == {"a": (1000, "a", 3), "b": (999, "a", 3), "c": (998, "a", 3), "d": (2000, "d", 1), "f": (4000, "f", 1)}
    assert eda.dropout_groups(df.where("false"), list("ab")).count() == 0


def test_draws_are_by_key(spark):
    rows = spark.range(4000)
    of = lambda df, c: [r[0] for r in df.orderBy("id").select(c).collect()]
    u, z = of(rows, uniform(F.col("id"), 5)), of(rows, normal(F.col("id"), 5))
    assert u == of(rows.repartition(13), uniform(F.col("id"), 5)) and u != of(rows, uniform(F.col("id"), 6))
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and abs(np.mean(z)) < 0.05 and abs(np.std(z) - 1) < 0.05
    noisy = rows.select("id", doe.with_noise(F.lit(0.3), "bernoulli", F.col("id"), seed=1).alias("b"))
    assert abs(noisy.agg(F.avg("b")).first()[0] - 0.3) < 0.03


def test_spearman_ranks_without_a_join_on_the_target(spark, monkeypatch):
    """Ties, nulls, a constant, an empty column and many distinct values; columns in parts; cells are never spelt out."""

    def ranked(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 4, 300), rng.normal(size=300), rng.random(300), np.full(300, 7.0), np.full(300, math.nan)], 1)
    t = np.round(x[:, 1] + rng.normal(size=300), 1)
    x[:, :3][rng.random((300, 3)) < 0.2] = math.nan
    t[::17] = math.nan
    df = frame(spark, np.column_stack([x, t]), "abcdet")
    staged, write = {}, eda.stage
    monkeypatch.setattr(eda, "stage", lambda d, name: staged.setdefault(name, []).append(write(d, name)) or staged[name][-1])
    for wide in (16, 2):
        monkeypatch.setattr(eda, "WIDE", wide, raising=False)
        staged.clear()
        got = {r["column_name"]: r["rho"] for r in eda.spearman(df, list("abcde"), "t").collect()}
        assert set(got) == set("abcd") and got["d"] is None
        for k, c in enumerate("abc"):
            both = ~np.isnan(x[:, k]) & ~np.isnan(t)
            assert got[c] == pytest.approx(np.corrcoef(ranked(x[both, k]), ranked(t[both]))[0, 1], abs=1e-12)
        assert "cells" not in staged and all(d.count() == len(np.unique(t[~np.isnan(t)])) for d in staged["targets"])
    whole = {r["column_name"]: r["rho"] for r in eda.spearman(df, list("abc"), "t").collect()}
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    monkeypatch.setattr(eda, "BROADCAST_ROWS", 10, raising=False)
    dealt = {r["column_name"]: r["rho"] for r in eda.spearman(df, list("abc"), "t").collect()}
    assert dealt == pytest.approx(whole, abs=1e-12)
