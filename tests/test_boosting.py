"""Boosting against a plain NumPy booster, and TreeSHAP against enumeration over all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.operators import boosting, models

PARAMS = dict(depth=3, rate=0.3, alpha=0.5, lam=1.0, least=1.0)


def table(n=240, seed=3, positives=0.3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 3, n)
    x[rng.random(x.shape) < 0.15] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=0.9) + 0.5 * (np.isnan(x[:, 1])) + 0.3 * np.nan_to_num(x[:, 2])
    return x, (signal + 0.5 * rng.normal(size=n) > np.quantile(signal, 1 - positives)).astype(int)


def frame(spark, x, y, parts=4):
    rows = [(i, *(None if math.isnan(v) and i % 2 else float(v) for v in r), int(l)) for i, (r, l) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int").repartition(parts, "k")


def plain_edges(column, bins):
    values, counts = np.unique(column[~np.isnan(column)], return_counts=True)
    if len(values) <= bins:
        return values[:-1].tolist()
    place = (counts.cumsum() - 1) * bins // counts.sum()
    return [values[place == p].max() for p in np.unique(place)][:-1]


def plain_booster(x, y, rounds, bins, depth, rate, alpha, lam, least):
    """Margins after each round: every split of every bin tried on rows."""
    edges = [plain_edges(x[:, j], bins) for j in range(x.shape[1])]
    margin, out = np.zeros(len(x)), []
    soft = lambda g: np.sign(g) * max(abs(g) - alpha, 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0) * boosting.SCALE
        g, h = np.rint((p - y) * w), np.rint(p * (1 - p) * w)
        step = np.zeros(len(x))

        def grow(rows, level):
            G, H = g[rows].sum() / boosting.SCALE, h[rows].sum() / boosting.SCALE
            best = None
            if level < depth:
                for j in range(x.shape[1]):
                    for nulls in (True, False):
                        for c in [*edges[j], np.inf]:
                            left = np.where(np.isnan(x[rows, j]), nulls, x[rows, j] <= c).astype(bool)
                            a, b = rows[left], rows[~left]
                            ga, ha, gb, hb = (v[r].sum() / boosting.SCALE for r in (a, b) for v in (g, h))
                            if ha < least or hb < least:
                                continue
                            gain = soft(ga) ** 2 / (ha + lam) + soft(gb) ** 2 / (hb + lam) - soft(G) ** 2 / (H + lam)
                            if gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                                best = (gain, a, b)
            if best is None:
                step[rows] = -rate * soft(G) / (H + lam)
                return
            grow(best[1], level + 1)
            grow(best[2], level + 1)

        grow(np.arange(len(x)), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.mark.parametrize("bins", [7, 511])
def test_equals_a_plain_booster_however_rows_are_dealt(spark, bins, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 2)  # margins are staged in between
    x, y = table()
    want = plain_booster(x, y, 5, bins, **PARAMS)
    fits = [boosting.boosted(frame(spark, x, y, n), ["a", "b", "c"], "y", rounds=5, bins=bins, **PARAMS)[0] for n in (1, 8)]
    assert fits[0].trees == fits[1].trees and len(fits[0].trees) == 5
    df = frame(spark, x, y)
    for k in (1, 5):
        got = df.select("k", boosting.margins(fits[0], k)(boosting._vector(fits[0].columns)).alias("m")).orderBy("k").toPandas()["m"]
        assert np.allclose(got, want[k - 1], atol=1e-12)


def test_models_grow_side_by_side_and_stop(spark):
    """Two models of complementary halves equal two models of the halves alone; held rows stop growth."""
    x, y = table(200)
    df = frame(spark, x, y)
    held = F.when(F.col("k") % 2 == 0, 1).otherwise(2).cast("long")
    both = boosting.boosted(df, ["a", "b", "c"], "y", rounds=12, held=held, models=2, patience=3, **PARAMS)
    for model, rest in zip(both, (1, 0), strict=True):
        alone = boosting.boosted(df.withColumn("y", F.when(F.col("k") % 2 == rest, F.col("y"))), ["a", "b", "c"], "y", rounds=len(model.trees), **PARAMS)[0]
        assert 1 <= len(model.trees) <= 12
        if model.edges == alone.edges:
            assert model.trees == alone.trees
    assert boosting.Boosted.from_json(both[0].to_json()) == both[0]


def test_models_use_only_their_columns(spark):
    x, y = table(160)
    df = frame(spark, x, y)
    chosen = [["a"], ["b", "c"]]
    both = boosting.boosted(df, ["a", "b", "c"], "y", rounds=3, models=2, chosen=chosen, **PARAMS)
    for model, names in zip(both, chosen, strict=True):
        used = {model.columns[n[boosting.FEATURE]] for t in model.trees for n in t if n[boosting.FEATURE] >= 0}
        assert used and used <= set(names)
        alone = boosting.boosted(df, names, "y", rounds=3, **PARAMS)[0]
        assert [[n[1:] for n in t] for t in model.trees] == [[n[1:] for n in t] for t in alone.trees]
    picked = []
    _, fits = models.cross_validated(df, "k", "y", ["a", "b", "c"], folds=2, repeats=1, rounds=2, depth=2, select=lambda part: picked.append(part.count()) or ["abc"[len(picked)]])
    assert [r["features"] for r in fits.orderBy("fold").collect()] == [["b"], ["c"]] and all(70 < n < 90 for n in picked)


def test_stops_at_the_best_round(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 3)
    rng = np.random.default_rng(1)
    x, y = rng.random((120, 3)), rng.integers(0, 2, 120)  # noise: nothing to gain
    held = F.when(F.col("k") % 3 == 0, 1).otherwise(0).cast("long")
    model = boosting.boosted(frame(spark, x, y), ["a", "b", "c"], "y", rounds=60, held=held, patience=4, **PARAMS)[0]
    assert len(model.trees) < 60
    rows = np.arange(120) % 3 == 0
    p = [m[rows] for m in np.cumsum([np.zeros(120)] + [_tree_margin(model, t, x) for t in model.trees], axis=0)[1:]]
    assert int(np.argmax(np.round([_precision(m, y[rows]) for m in p], 12))) == len(p) - 1


def _tree_margin(model, tree, x):
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(model.edges)], 1)
    t = boosting._arrays(tree)
    return t[boosting.VALUE][boosting._leaf(t, bins, 10**4)]


def _precision(score, y):
    out = 0.0
    for s in np.unique(score):
        flagged = score >= s
        out += y[score == s].sum() / y.sum() * y[flagged].mean()
    return out


def test_edges_of_tables(spark):
    x, y = table(60)
    df = frame(spark, x, y)
    empty = boosting.boosted(df.where("false"), ["a", "b"], "y", rounds=2, **PARAMS)[0]
    assert df.select(boosting.probability(empty).alias("p")).distinct().first()["p"] == 0.5
    one_class = boosting.boosted(df.withColumn("y", F.lit(0)), ["a", "b"], "y", rounds=2, **PARAMS)[0]
    assert one_class.columns == ["a", "b"] and len(one_class.trees) == 2
    nulls = boosting.boosted(df.withColumn("a", F.lit(None).cast("double")), ["a", "c"], "y", rounds=2, **PARAMS)[0]
    assert all(n[boosting.FEATURE] != 0 for t in nulls.trees for n in t)
    with pytest.raises(ValueError):
        boosting.boosted(df, ["a"], "y", models=64)


def enumerated(tree, bins, none):
    """Shapley values by the definition; unknown columns are averaged by cover."""

    def value(node, known):
        f, cut, nulls, left, right, v, cover = tree[node]
        if f < 0:
            return v
        if f in known:
            return value(left if (nulls if bins[f] == none else bins[f] <= cut) else right, known)
        return sum(value(c, known) * tree[c][boosting.COVER] for c in (left, right)) / cover

    columns = range(len(bins))
    out = np.zeros(len(bins))
    for i in columns:
        rest = [j for j in columns if j != i]
        for k in range(len(rest) + 1):
            for s in itertools.combinations(rest, k):
                share = math.factorial(k) * math.factorial(len(bins) - 1 - k) / math.factorial(len(bins))
                out[i] += share * (value(0, {*s, i}) - value(0, set(s)))
    return out


def test_contributions_equal_enumeration_and_add_up(spark):
    x, y = table()
    df = frame(spark, x, y)
    model = boosting.boosted(df, ["a", "b", "c"], "y", rounds=4, bins=20, **{**PARAMS, "depth": 4})[0]
    got = boosting.contributions(model, df, "k").groupBy("k").pivot("feature", ["a", "b", "c"]).agg(F.first("contribution")).orderBy("k").toPandas().set_index("k").to_numpy()
    none = max(map(len, model.edges)) + 1
    bins = np.stack([np.where(np.isnan(x[:, j]), none, np.searchsorted(e, x[:, j], "left")) for j, e in enumerate(model.edges)], 1)
    want = np.array([sum(enumerated(t, b, none) for t in model.trees) for b in bins])
    assert np.allclose(got, want, atol=1e-10) and np.abs(want).max() > 0.1
    margin = df.select("k", boosting.margins(model)(boosting._vector(model.columns)).alias("m")).orderBy("k").toPandas()["m"]
    assert np.allclose(got.sum(1) + boosting.expectation(model), margin, atol=1e-10)
    top = boosting.importance(boosting.contributions(model, df, "k")).orderBy(F.desc("mean_abs")).first()
    assert top["mean_abs"] == pytest.approx(np.abs(want).mean(0).max())


def test_cross_validated_refit_and_saved(spark, tmp_path):
    """Each key once a repeat, by a model that has not seen it; saved models score alike."""
    x, y = table(300)
    rows = frame(spark, x, y).withColumn("fold__", F.lit("x"))
    scores, fits = models.cross_validated(rows, "k", "y", ["a", "b", "c"], folds=3, repeats=2, rounds=8, depth=3, rate=0.3)
    assert scores.count() == 600 and scores.groupBy("repeat").agg(F.count_distinct("k").alias("n")).collect()[0]["n"] == 300
    folds = {(r["repeat"], r["k"]): r["fold"] for r in models.stratified_folds(rows, "k", "y", 3, 2).collect()}
    assert all(folds[r["repeat"], r["k"]] == r["fold"] and 0 < r["p"] < 1 for r in scores.collect())
    got = fits.orderBy("repeat", "fold").collect()
    assert [(r["repeat"], r["fold"]) for r in got] == list(itertools.product((1, 2), range(3)))
    for r in got:
        mine = scores.where((F.col("repeat") == r["repeat"]) & (F.col("fold") == r["fold"])).toPandas()
        s, t = mine["p"].to_numpy(), mine["y"].to_numpy()
        assert r["average_precision"] == pytest.approx(_precision(s, t)) and r["brier"] == pytest.approx(((s - t) ** 2).mean())
        assert r["roc_auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in s[t == 1] for b in s[t == 0]])) and 1 <= r["n_trees"] <= 8
    model = models.refit(rows, "y", ["a", "b", "c"], fits=fits, depth=3)
    assert len(model.trees) == int(np.median([r["n_trees"] for r in got]))
    models.save_model(model, f"file://{tmp_path}/m")
    again = models.load_model(spark, f"file://{tmp_path}/m")
    assert again == model and len(models.refit(rows, "y", ["a"], rounds=3).trees) == 3
    for kind in ("platt", "isotonic"):
        cal = getattr(models, kind)(scores, "p", "y")
        models.save_model(cal, f"file://{tmp_path}/{kind}")
        back = models.load_model(spark, f"file://{tmp_path}/{kind}")
        one, other = (models.calibrated(m, scores).orderBy("k", "repeat").toPandas()["p_cal"].tolist() for m in (cal, back))
        assert one == other
    chosen = spark.createDataFrame([(["a", "b"],), (["a", "a"],)], "features array<string>")
    assert {(r["feature"], r["n"], r["share"]) for r in models.selection_counts(chosen).collect()} == {("a", 2, 1.0), ("b", 1, 0.5)}


def test_cross_validation_moves_rows_once_a_repeat(spark, monkeypatch):
    """Rows carry their folds: one shuffle a repeat, no join of rows; rows of one key have a fold each."""
    staged, write = {}, models.stage
    monkeypatch.setattr(models, "stage", lambda df, name: staged.setdefault(name, df) and write(df, name))
    x, y = table(200)
    rows = frame(spark, x, y)
    models.cross_validated(rows, "k", "y", ["a", "b", "c"], folds=3, repeats=2, rounds=1, depth=1)
    text = staged["training"]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in text
    scores, _ = models.cross_validated(rows.union(rows), "k", "y", ["a", "b", "c"], folds=3, repeats=2, rounds=1, depth=1)
    sizes = {(r["repeat"], r["fold"], r["y"]): r["n"] for r in scores.groupBy("repeat", "fold", "y").agg(F.count("*").alias("n")).collect()}
    assert scores.count() == 800 and len(sizes) == 12
    for label in (0, 1):
        dealt = [n for (_, _, y), n in sizes.items() if y == label]
        assert max(dealt) - min(dealt) <= 1


def test_rows_packed_and_rows_alike():
    x = np.random.default_rng(2).integers(0, 9, (50, 3)).astype(np.uint16)
    packed = boosting._packed(x)
    assert packed.to_pylist() == [r.tobytes() for r in x]
    assert (boosting._matrix(packed.slice(7, 20), np.uint16, 3) == x[7:27]).all() and boosting._matrix(packed.slice(0, 0), float, 2).shape == (0, 2)
    tree = [(0, 3, True, 1, 2, 0.0, 3.0), (2, 5, False, 3, 4, 0.0, 2.0), (-1, 0, False, -1, -1, 0.7, 1.0), (-1, 0, False, -1, -1, -0.2, 1.0), (-1, 0, False, -1, -1, 0.4, 1.0)]
    first, of = boosting._alike(boosting._cuts(tree), x, 8)
    leaves = boosting._leaf(boosting._arrays(tree), x, 8)
    assert len(first) <= 9 and (leaves[first][of] == leaves).all()
    assert leaves.tolist() == [2 if not (r[0] <= 3 or r[0] == 8) else 3 if r[2] <= 5 else 4 for r in x]
