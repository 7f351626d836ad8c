"""Surrogate experiments: designs, expansion over a background, cell statistics, effects and OOD distances."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.functions.draws import normal, uniform
from yieldspark.functions.stats import inverse_logit, logit
from yieldspark.operators.features import missingness_features
from yieldspark.operators.moments import mean_and_covariance
from yieldspark.operators.ordering import column_quantiles, grouped_quantiles, positions
from yieldspark.sources.staging import stage

MIN_BACKGROUND = 20

#: Points of a leaf in nearest-neighbour searches, and of the sample that balances the leaves.
LEAF, SAMPLE = 4096, 50_000
#: Coordinates compared at once.
CELLS = 1 << 22


def factor_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """factor, low, center, high: the linear 10, 50 and 90 % quantiles."""
    return column_quantiles(df, columns, {"low": 0.1, "center": 0.5, "high": 0.9}).withColumnRenamed("column_name", "factor")


def rank_factors(candidates: DataFrame, first: str, factor: str = "factor", importance: str = "importance") -> DataFrame:
    """`first` leads, then importance descending with unknown ones last, then by name."""
    order = [F.when(F.col(factor) == first, 0).otherwise(1), F.col(importance).isNull(), -F.col(importance), F.col(factor)]
    placed = positions(candidates, order, "place")
    return placed.withColumn("place", F.col("place") + 1)


def coded_design(factors: list[str], generator: str | None = None) -> list[tuple[int, ...]]:
    """Two-level coded rows, the first factor fastest. generator: words of base letters, as "a b ab"."""
    words = (generator or " ".join("abcdefghijklmnop"[i] for i in range(len(factors)))).split()
    if len(words) != len(factors):
        raise ValueError(f"generator has {len(words)} columns for {len(factors)} factors")
    base = sorted({c for w in words for c in w.lstrip("-")})
    out = []
    for levels in itertools.product((-1, 1), repeat=len(base)):
        of = dict(zip(base, levels[::-1], strict=True))
        out.append(tuple((-1 if w[0] == "-" else 1) * int(np.prod([of[c] for c in w.lstrip("-")])) for w in words))
    return out


def factorial_design(spark: SparkSession, factors: list[dict], replicates: int = 1, centers: int = 0, generator: str | None = None, seed: int | None = None) -> DataFrame:
    """run_id, design_row, is_center, replicate, <f>_coded, <f>, is_replicate, run_order.

    factors: {name, low, high[, center]}. All corner rows repeat for each replicate; center rows follow. The
    run order is by md5(seed|design_row), or the design order without a seed.
    """
    names = [f["name"] for f in factors]
    corners = coded_design(names, generator)
    rows = [(c, False, r + 1) for r in range(replicates) for c in corners] + [((0,) * len(names), True, 1)] * centers
    drawn = [hashlib.md5(f"{seed}|{k + 1}".encode()).hexdigest() if seed is not None else "" for k in range(len(rows))]
    order = np.argsort(np.argsort(drawn, kind="stable")) + 1
    out = []
    for k, (coded, center, replicate) in enumerate(rows):
        actual = [f.get("center", (f["low"] + f["high"]) / 2) if c == 0 else f["high"] if c > 0 else f["low"] for f, c in zip(factors, coded, strict=True)]
        out.append((f"doe_{k + 1:03d}", k + 1, center, replicate, *map(float, coded), *map(float, actual), replicate > 1, int(order[k])))
    kind = "run_id string, design_row long, is_center boolean, replicate long, " + ", ".join(f"{n}_coded double" for n in names) + ", " + ", ".join(f"{n} double" for n in names) + ", is_replicate boolean, run_order long"
    return spark.createDataFrame(out, kind)


def expand_design(background: DataFrame, design: DataFrame, factors: list[str]) -> DataFrame:
    """Every background row under every design row, its factor values replaced; the design is a bounded table."""
    own = [c for c in background.columns if c not in design.columns or c in factors]
    keep = background.select(*(c for c in own if c not in factors))
    return keep.crossJoin(F.broadcast(design))


def with_noise(p: Column, kind: str | None, key: Column, scale: float = 0.1, seed: int = 0) -> Column:
    """Observed response: None (the probability), bernoulli, or logit-gaussian; each key has its draw."""
    if kind is None:
        return p
    if kind == "bernoulli":
        return (uniform(key, seed) < p).cast("double")
    if kind == "logit-gaussian":
        return inverse_logit(logit(p) + scale * normal(key, seed))
    raise ValueError(f"unknown noise {kind}")


def score_design(background: DataFrame, design: DataFrame, factors: list[str], scorer: Callable[[DataFrame], DataFrame], groups: dict[str, list[str]], sensors: list[str]) -> DataFrame:
    """Surrogate scores of every background row under every design row.

    Factor values are written into the raw sensors first and missingness features are rebuilt after, so a
    factor over a missing cell lowers the row's missing rate; scorer adds score_raw.
    """
    return scorer(missingness_features(expand_design(background, design, factors), groups, sensors))


def cell_summary(rows: DataFrame, keys: list[str], response: str) -> DataFrame:
    """n, mean and std (0 for a single row) of each cell; null keys form cells of their own."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(response).alias("mean"), F.coalesce(F.stddev_samp(response), F.lit(0.0)).alias("std"))


def bernoulli_cells(rows: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col(y).cast("long")).alias("failures"), F.count(F.lit(1)).alias("trials"), F.avg(p).alias("expected"))


def main_effects(cells: DataFrame, factors: list[str], response: str = "mean") -> DataFrame:
    """factor, low_mean, high_mean, effect: mean response at a factor's greatest level less that at its least."""
    ends = cells.agg(*(F.struct(F.min(f).alias("a"), F.max(f).alias("b")).alias(f"{f}__") for f in factors))
    both = cells.crossJoin(F.broadcast(ends))
    wide = both.agg(*(F.struct(F.avg(F.when(F.col(f) == F.col(f"{f}__.a"), F.col(response))).alias("low_mean"), F.avg(F.when(F.col(f) == F.col(f"{f}__.b"), F.col(response))).alias("high_mean")).alias(f) for f in factors))
    return wide.unpivot([], factors, "factor", "e").select("factor", "e.*").withColumn("effect", F.col("high_mean") - F.col("low_mean"))


def curvature(cells: DataFrame, center: Column, response: str = "mean") -> DataFrame:
    """center_mean, corner_mean, n_center, curvature (null without center rows)."""
    out = cells.agg(F.avg(F.when(center, F.col(response))).alias("center_mean"), F.avg(F.when(~center, F.col(response))).alias("corner_mean"), F.count_if(center).alias("n_center"))
    return out.withColumn("curvature", F.col("center_mean") - F.col("corner_mean"))


def recommend(cells: DataFrame, key: str, response: str = "mean") -> DataFrame:
    """The first cell of the least response."""
    return cells.agg(F.min_by(F.struct(key, response), F.struct(response, key)).alias("b")).select("b.*")


def _terms(factors: list[str]) -> list[tuple[str, Column]]:
    pairs = [(f"{a}:{b}", F.col(a) * F.col(b)) for a, b in itertools.combinations(factors, 2)]
    return [(f, F.col(f)) for f in factors] + pairs


def ols_effects(cells: DataFrame, factors: list[str], response: str = "mean") -> DataFrame:
    """term, estimate, std_error, t_value, p_value of the coded factors and their pairwise products.

    A saturated model (as many cells as terms) has estimates only."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    terms = _terms(factors)
    x = cells.select(F.col(response).alias("label"), *(c.alias(f"x{k}") for k, (_, c) in enumerate(terms)))
    x = VectorAssembler(inputCols=[f"x{k}" for k in range(len(terms))], outputCol="features").transform(x)
    model = LinearRegression(solver="normal").fit(x)
    s = model.summary
    estimates = [*model.coefficients, model.intercept]
    tests = (s.coefficientStandardErrors, s.tValues, s.pValues) if s.degreesOfFreedom > 0 else [[None] * len(estimates)] * 3
    rows = [(t, float(e), *(None if v is None else float(v) for v in x)) for t, e, *x in zip([t for t, _ in terms] + ["intercept"], estimates, *tests, strict=True)]
    return cells.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")


def glm_effects(cells: DataFrame, factors: list[str], failures: str = "failures", trials: str = "trials") -> DataFrame:
    """term, estimate (log odds), odds_ratio, std_error, p_value of a binomial GLM on failures of trials."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    terms = _terms(factors)
    x = cells.select((F.col(failures) / F.col(trials)).alias("label"), F.col(trials).cast("double").alias("w"), *(c.alias(f"x{k}") for k, (_, c) in enumerate(terms)))
    x = VectorAssembler(inputCols=[f"x{k}" for k in range(len(terms))], outputCol="features").transform(x)
    model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="w").fit(x)
    s = model.summary
    estimates = [*map(float, model.coefficients), float(model.intercept)]
    rows = list(zip([t for t, _ in terms] + ["intercept"], estimates, np.exp(estimates).tolist(), map(float, s.coefficientStandardErrors), map(float, s.pValues), strict=True))
    return cells.sparkSession.createDataFrame(rows, "term string, estimate double, odds_ratio double, std_error double, p_value double")


def studentized_residuals(cells: DataFrame, factors: list[str], key: str, response: str = "mean") -> DataFrame:
    """key, fitted, residual, leverage, studentized: the hat matrix's diagonal from (X'X)^-1 of a small model."""
    terms = _terms(factors)
    columns = [F.lit(1.0), *(c.cast("double") for _, c in terms)]
    k = len(columns)
    sums = cells.agg(*(F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(c * F.col(response)).alias(f"h{i}") for i, c in enumerate(columns)), F.sum(F.col(response) ** 2).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(gram)
    beta = inverse @ np.array([sums[f"h{i}"] for i in range(k)])
    s2 = max(sums["yy"] - beta @ gram @ beta, 0.0) / max(sums["n"] - k, 1)
    fitted = sum((F.lit(float(b)) * c for b, c in zip(beta, columns, strict=True)), F.lit(0.0))
    leverage = sum((F.lit(float(inverse[i, j])) * columns[i] * columns[j] for i in range(k) for j in range(k)), F.lit(0.0))
    out = cells.select(key, fitted.alias("fitted"), (F.col(response) - fitted).alias("residual"), leverage.alias("leverage"))
    return out.withColumn("studentized", F.when((F.col("leverage") < 1 - 1e-12) & F.lit(s2 > 0), F.col("residual") / F.sqrt(F.lit(float(s2)) * (1 - F.col("leverage")))))


def mahalanobis(rows: DataFrame, reference: DataFrame, columns: list[str], name: str = "mahalanobis", moments: tuple | None = None) -> DataFrame:
    """rows with their distance to the reference's mean under the pseudo-inverse of its covariance (complete rows);
    null where a column is null. Any number of columns: moments are summed in blocks, or given (as
    mean_and_covariance gives them) where several tables are held against one reference."""
    n, mean, cov = moments or mean_and_covariance(reference, columns)
    if n < MIN_BACKGROUND:
        raise ValueError(f"only {n} complete background rows; {MIN_BACKGROUND} are needed")
    inverse = np.linalg.pinv(cov)

    @F.arrow_udf("double")
    def distance(values: pa.Array) -> pa.Array:
        d = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)).astype(float) - mean
        square = ((d @ inverse) * d).sum(1)
        return pa.array(np.sqrt(np.maximum(square, 0.0)), mask=np.isnan(square))

    return rows.withColumn(name, distance(F.array(*(F.col(c).cast("double") for c in columns))))


@dataclass(frozen=True)
class Leaves:
    """Boxes that halve the space until each holds about LEAF points; nodes are numbered, children follow parents."""

    low: np.ndarray  # nodes x columns
    high: np.ndarray
    dim: np.ndarray  # column that a node cuts, -1 for a leaf
    cut: np.ndarray
    left: np.ndarray  # the right child is the next node

    @classmethod
    def of(cls, sample: np.ndarray, share: float) -> Leaves:
        """From a sample of the points, a `share` of them: it only balances the leaves, any cut gives right results."""
        k = sample.shape[1]
        low, high, dim, cut, left, rows = [np.full(k, -np.inf)], [np.full(k, np.inf)], [], [], [], [sample]
        while (node := len(dim)) < len(rows):
            own, rows[node] = rows[node], None
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(k)
            d = int(spread.argmax())
            if len(own) <= LEAF * share or not spread[d]:
                dim.append(-1), cut.append(0.0), left.append(-1)
                continue
            middle = float(np.median(own[:, d]))
            middle = middle if middle < own[:, d].max() else float(own[:, d].min())
            dim.append(d), cut.append(middle), left.append(len(rows))
            for below in (True, False):
                rows.append(own[(own[:, d] <= middle) == below])
                low.append(low[node].copy()), high.append(high[node].copy())
                (high if below else low)[-1][d] = middle
        return cls(np.array(low), np.array(high), np.array(dim), np.array(cut), np.array(left))

    def of_points(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(x), int)
        while len(inner := np.flatnonzero(self.dim[at] >= 0)):
            node = at[inner]
            at[inner] = self.left[node] + (x[inner, self.dim[node]] > self.cut[node])
        return at

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves no farther from a point than its reach."""
        point, node, found = np.arange(len(x)), np.zeros(len(x), int), [(np.zeros(0, int), np.zeros(0, int))]
        while len(point):
            gap = np.maximum(np.maximum(self.low[node] - x[point], x[point] - self.high[node]), 0.0)
            near = np.sqrt((gap**2).sum(1)) <= reach[point] * (1 + 1e-12)
            point, node = point[near], node[near]
            leaf = self.dim[node] < 0
            found.append((point[leaf], node[leaf]))
            point, node = np.repeat(point[~leaf], 2), np.repeat(self.left[node[~leaf]], 2) + np.tile([0, 1], int((~leaf).sum()))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Neighbours:
    """The different points of a reference, dealt into leaves once, for any number of searches.

    What comes to the driver is a sample of SAMPLE points, to balance the leaves.
    """

    def __init__(self, reference: DataFrame, columns: list[str]) -> None:
        self.xs = xs = [f"x{i}" for i in range(len(columns))]
        self.sql = [F.col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)]
        points = stage(reference.select(*self.sql).dropna().groupBy(*xs).agg(F.count(F.lit(1)).alias("times")), "points")
        share = min(1.0, SAMPLE / max(points.count(), 1))
        sample = points.select(*xs) if share == 1 else points.sample(share, seed=5).select(*xs)
        self.leaves = Leaves.of(sample.toPandas().to_numpy(float).reshape(-1, len(xs)), share)
        self.coordinates = ", ".join(f"{x} double" for x in xs)
        self.placed = stage(points.mapInPandas(self._dealt(), f"{self.coordinates}, times long, leaf long"), "leaves")

    def _dealt(self) -> Callable:
        leaves, xs = self.leaves, self.xs

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(leaf=leaves.of_points(b[xs].to_numpy(float)))

        return dealt

    def distances(self, queries: DataFrame, key: str, k: int) -> DataFrame:
        """key, knn_distance, as knn_distance() gives them."""
        leaves, xs, placed = self.leaves, self.xs, self.placed

        def nearest(q: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            """The k least distances of each query to the leaf's points."""
            at, times, best = y[xs].to_numpy(float), np.minimum(y["times"].to_numpy(int), k), []
            step = max(1, CELLS // max(at.size, 1))
            for low in range(0, len(q), step):
                d = np.sqrt(((q[xs].to_numpy(float)[low : low + step, None, :] - at[None]) ** 2).sum(2))
                few = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.arange(d.shape[1])[None].repeat(len(d), 0)
                best += [np.sort(np.repeat(row[f], times[f]))[:k].tolist() for row, f in zip(d, few, strict=True)]
            return q[xs].assign(best=pd.Series(best, q.index, object))

        def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b[xs].to_numpy(float)
                reach = np.array([d[k - 1] if len(d) == k else np.inf for d in b["best"]])
                point, leaf = leaves.within(x, reach)
                other = leaf != leaves.of_points(x)[point]
                yield b[xs].iloc[point[other]].assign(leaf=leaf[other])

        found = f"{self.coordinates}, best array<double>"
        search = lambda q: q.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(nearest, found)
        wanted = queries.select(key, *self.sql).dropna(subset=xs)
        own = stage(search(wanted.select(*xs).distinct().mapInPandas(self._dealt(), f"{self.coordinates}, leaf long")), "own_leaf")
        every = own.unionByName(search(own.mapInPandas(further, f"{self.coordinates}, leaf long")))
        least = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        merged = every.groupBy(*xs).agg(least.alias("best")).where(F.size("best") > 0)
        mean = F.aggregate("best", F.lit(0.0), lambda n, d: n + d) / F.size("best")
        return wanted.join(merged.select(*xs, mean.alias("knn_distance")), xs).select(key, "knn_distance")


def knn_distance(queries: DataFrame, reference: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """key, knn_distance: mean unscaled Euclidean distance to the k nearest reference rows (all, if fewer).

    Exact: the reference's different points are dealt into leaves; a query's own leaf bounds its k-th distance,
    then only leaves within that bound are searched. Rows that are equal count by their number. Rows with a
    null coordinate are left out.
    """
    return Neighbours(reference, columns).distances(queries, key, k)


def ood_table(design: DataFrame, background: DataFrame, factors: list[str], key: str = "run_id", ref_key: str = "wafer_id", k: int = 5) -> DataFrame:
    """Distances of the design rows with 99 % thresholds of the background's own, and ood_flag.

    The background's kNN distances to itself use k + 1 neighbours, the zero to itself included.
    """
    whole = background.dropna(subset=factors)
    limit = lambda df, c: grouped_quantiles(df, [], c, {"q": 0.99}).first()["q"]
    moments = mean_and_covariance(whole, factors)
    far_m = limit(mahalanobis(whole, whole, factors, moments=moments), "mahalanobis")
    near = Neighbours(whole, factors)
    far_k = limit(near.distances(whole, ref_key, k + 1), "knn_distance")
    out = mahalanobis(design, whole, factors, moments=moments).join(near.distances(design, key, k), key, "left")
    return out.withColumns({"mahalanobis_threshold_q99": F.lit(far_m), "knn_threshold_q99": F.lit(far_k)}).withColumn("ood_flag", (F.col("mahalanobis") > far_m) | (F.col("knn_distance") > far_k))
