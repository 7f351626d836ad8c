"""Second-order boosting with L1 and L2 terms, nulls by a learned direction, and TreeSHAP, as Spark jobs.

Columns are cut into at most `bins` equal-frequency bins and staged once as packed numbers. A level of a tree
is one job: each task sums gradients and hessians of its rows by node, column and bin, the tasks' sums meet by
(node, column), and the best split of each node comes to the driver. Gradients are whole multiples of 1/SCALE,
so sums, and with them trees, do not depend on how rows are dealt. Several models (cross-validation) grow in
the same jobs: a row carries a margin and a held-out flag for each. Margins are staged every CHUNK trees; in
between tasks replay the few trees since.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.operators.ordering import running_sums
from yieldspark.sources.staging import stage

#: Gradients and hessians are rounded to 1 / SCALE; weights balance the classes, so sums of 4e12 rows fit 64 bits.
SCALE = 1 << 20
#: Trees between two writes of the margins.
CHUNK = 10
#: Gains up to this are no split.
LEAST_GAIN = 1e-6
_SUMS = "model int, node int, feature int, g binary, h binary"
_SPLITS = "model int, node int, feature int, gain double, cut int, nulls_left boolean, gl long, hl long, gr long, hr long"
# A node: column (-1 in a leaf), last bin of the left side, whether nulls go left, children, value, hessian.
FEATURE, CUT, NULLS, LEFT, RIGHT, VALUE, COVER = range(7)


@dataclass
class Boosted:
    """columns, their bin edges, and trees as lists of nodes; the margin is the sum of leaf values."""

    columns: list[str]
    edges: list[list[float]]
    trees: list[list[tuple]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps([self.columns, self.edges, self.trees])

    @staticmethod
    def from_json(text: str) -> Boosted:
        columns, edges, trees = json.loads(text)
        return Boosted(columns, edges, [[tuple(n) for n in t] for t in trees])


def _vector(columns: list[str]) -> Column:
    """The columns as an array of doubles; NaN counts as null."""
    x = (F.col(c).cast("double") for c in columns)
    return F.array(*(F.when(~F.isnan(c), c) for c in x))


def bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """For each column its bins' upper ends, but for the last: every value its own bin where there are no more
    than `bins` of them, else bins of equal frequency. Nulls have no bin. Exact, by counted distinct values."""
    long = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    counts = stage(long.where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    ranked = running_sums(counts, [F.col("value")], {"upto": F.col("n"), "nth": F.lit(1).cast("long")}, keys=["column_name"])
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))  # a row a column
    place = F.when(F.col("distinct") <= bins, F.col("nth")).otherwise(F.floor((F.col("upto") - 1) * bins / F.col("total")))
    ends = ranked.join(F.broadcast(totals), "column_name").groupBy("column_name", place.alias("place")).agg(F.max("value").alias("value"))
    found: dict[str, list[float]] = {c: [] for c in columns}
    for r in ends.collect():  # `bins` rows a column
        found[r["column_name"]].append(r["value"])
    return [sorted(found[c])[:-1] for c in columns]


def _bins(values: pa.Array, edges: list[np.ndarray], none: int) -> np.ndarray:
    """Bin numbers of an array column, a row each; `none` for nulls."""
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges)).astype(float)
    out = np.empty(x.shape, np.uint16)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), none, np.searchsorted(e, x[:, k], "left"))
    return out


def _arrays(tree: list[tuple]) -> list[np.ndarray]:
    return [np.array(c) for c in zip(*tree, strict=True)]


def _all_arrays(recent: dict[int, list[list[tuple]]]) -> dict[int, list[list[np.ndarray]]]:
    return {m: [_arrays(t) for t in trees] for m, trees in recent.items()}


def _leaf(tree: list[np.ndarray], x: np.ndarray, none: int) -> np.ndarray:
    """The node in which each row of bins ends. All rows step together, a level at a time; leaves lead to themselves."""
    inner = tree[FEATURE] >= 0
    own = np.arange(len(inner))
    feature, cut = np.where(inner, tree[FEATURE], 0), tree[CUT]
    least = np.where(tree[NULLS].astype(bool), none, np.iinfo(np.int64).max)  # bins from here go left: nulls, or none
    child = np.stack([np.where(inner, tree[RIGHT], own), np.where(inner, tree[LEFT], own)], 1).ravel()
    flat, start, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), int)
    reached = own[:1]
    while inner[reached].any():
        if len(reached) == 1:  # the root: one column, one cut
            b = x[:, feature[0]]
            left = (b <= cut[0]) & (b != none) | (b >= least[0])
        else:
            b = flat[start + feature[at]]
            left = (b <= cut[at]) & (b != none) | (b >= least[at])
        at = child[2 * at + left]
        reached = np.unique(np.concatenate([child[2 * reached], child[2 * reached + 1]]))
    return at


@dataclass
class _Job:
    """What tasks need: models that still grow, their trees since margins were staged, and the tree in the making."""

    columns: int
    none: int
    weight: list[float]
    recent: dict[int, list[list[tuple]]]
    growing: dict[int, list[tuple]]
    open: dict[int, list[int]]


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of one length as rows of a matrix, without a copy."""
    n = len(column)
    if n == 0:
        return np.empty((0, width), kind)
    _, ends, data = column.cast(pa.binary()).buffers()
    first = int(np.frombuffer(ends, np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(data, kind, n * width, first).reshape(n, width)


def _unpacked(batch: pa.RecordBatch, columns: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins, labels, margins and held flags of a batch."""
    x, margin = _matrix(batch.column("bins"), np.uint16, columns), _matrix(batch.column("margins"), float, models).copy()
    return x, batch.column("y").to_numpy(), margin, batch.column("held").to_numpy().astype(np.uint64)


def _grown(x: np.ndarray, margin: np.ndarray, recent: dict[int, list[list[np.ndarray]]], none: int) -> None:
    """Adds the recent trees to the margins, in place."""
    for m, trees in recent.items():
        for t in trees:
            margin[:, m] += t[VALUE][_leaf(t, x, none)]


def _task_sums(sent, models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job: _Job = sent.value
        width = job.none + 1
        recent, growing = _all_arrays(job.recent), {m: _arrays(t) for m, t in job.growing.items()}
        sums = {m: np.zeros((2, len(nodes) * job.columns * width), np.int64) for m, nodes in job.open.items()}
        for b in batches:
            x, y, margin, held = _unpacked(b, job.columns, models)
            _grown(x, margin, recent, job.none)
            for m, nodes in job.open.items():
                p = 1 / (1 + np.exp(-margin[:, m]))
                weight = np.where(y == 1, job.weight[m], 1.0) * SCALE
                slot = np.full(len(job.growing[m]), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[_leaf(growing[m], x, job.none)]
                at[(held >> np.uint64(m)) & np.uint64(1) == 1] = -1
                rows = np.flatnonzero(at >= 0)
                cell = ((at[rows, None] * job.columns + np.arange(job.columns)) * width + x[rows]).ravel()
                for k, v in enumerate((np.rint((p - y) * weight), np.rint(p * (1 - p) * weight))):
                    sums[m][k] += np.bincount(cell, np.repeat(v[rows], job.columns), sums[m].shape[1]).astype(np.int64)
        for m, nodes in job.open.items():
            both = sums[m].reshape(2, len(nodes), job.columns, width)
            for i, node in enumerate(nodes):
                n = job.columns
                yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int32()), pa.array([node] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array([r.tobytes() for r in both[k, i]], pa.binary()) for k in (0, 1))], ["model", "node", "feature", "g", "h"])

    return run


def leaf_value(g: float, h: float, alpha: float, lam: float) -> float:
    """The weight that minimises the second-order loss with L1 term alpha and L2 term lam."""
    return -math.copysign(max(abs(g) - alpha, 0.0), g) / (h + lam) if h + lam > 0 else 0.0


def _part(g: np.ndarray, h: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    return np.maximum(np.abs(g) - alpha, 0) ** 2 / np.maximum(h + lam, 1e-300)


def _best_split(alpha: float, lam: float, least: float, allowed: list[set[int]] | None):
    """The best split of a node and column from all tasks' sums: over bins, with nulls on either side; none of a
    column that its model may not use."""

    def run(table: pa.Table) -> pa.Table:
        g, h = (sum(np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()) for c in ("g", "h"))
        total = g.sum(), h.sum()
        best = (-1.0, 0, False, int(total[0]), int(total[1]), 0, 0)
        whole = _part(total[0] / SCALE, total[1] / SCALE, alpha, lam)
        closed = allowed is not None and table["feature"][0].as_py() not in allowed[table["model"][0].as_py()]
        for left in () if closed else (True, False):
            gl, hl = (np.cumsum(v[:-1]) + (v[-1] if left else 0) for v in (g, h))
            gr, hr = total[0] - gl, total[1] - hl
            gain = _part(gl / SCALE, hl / SCALE, alpha, lam) + _part(gr / SCALE, hr / SCALE, alpha, lam) - whole
            gain[(hl < least * SCALE) | (hr < least * SCALE)] = -1
            k = int(gain.argmax())
            if gain[k] > max(best[0], LEAST_GAIN):
                best = (float(gain[k]), k, left, int(gl[k]), int(hl[k]), int(gr[k]), int(hr[k]))
        head = [table.column(c).slice(0, 1) for c in ("model", "node", "feature")]
        names = [f.split()[0] for f in _SPLITS.split(", ")]
        kinds = [pa.float64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4]
        return pa.table([*head, *(pa.array([v], k) for v, k in zip(best, kinds, strict=True))], names)

    return run


def boosted(df: DataFrame, columns: list[str], label: str, rounds: int = 5000, depth: int = 4, rate: float = 0.03, bins: int = 511, alpha: float = 3.0, lam: float = 2.0, least: float = 1.0, held: Column | None = None, models: int = 1, patience: int = 100, gain: float = 1e-5, chosen: list[list[str]] | None = None) -> list[Boosted]:
    """`models` boosted classifiers of a 0/1 label, positives weighted to balance; rows without a label are left out.

    held is a long whose bit m keeps a row out of model m; a model with held rows stops once their average
    precision has not risen by `gain` for `patience` rounds and is cut to its best round. Leaves have a hessian
    of `least` at least. Nulls and NaN go to the side of each split that gains more. chosen names the columns
    that each model may split on (all, if not given). Up to 63 models. The
    driver holds the trees, and `bins` edges a column; a task holds sums of 2 ** (depth - 1) nodes a model.
    """
    if models > 63 or bins > 65_000:
        raise ValueError("at most 63 models and 65,000 bins")
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull())
    edges = bin_edges(known, columns, bins)
    none = bins
    ends = [np.array(e) for e in edges]

    @F.arrow_udf("binary")
    def packed(values: pa.Array) -> pa.Array:
        return _packed(_bins(values, ends, none))

    flags = F.lit(0).cast("long") if held is None else F.coalesce(held, F.lit(0).cast("long"))
    rows = stage(known.select(F.col(label).cast("int").alias("y"), flags.alias("held"), packed(_vector(columns)).alias("bins"), F.lit(bytes(8 * models)).alias("margins")), "binned")
    bit = [(F.shiftright("held", m) % 2) == 1 for m in range(models)]
    counts = rows.agg(*(F.count_if(~b & (F.col("y") == v)).alias(f"n{v}_{m}") for m, b in enumerate(bit) for v in (0, 1)), *(F.count_if(b).alias(f"held_{m}") for m, b in enumerate(bit))).first()
    weight = [counts[f"n0_{m}"] / max(counts[f"n1_{m}"], 1) for m in range(models)]
    allowed = None if chosen is None else [{columns.index(c) for c in names} for names in chosen]
    out = [Boosted(list(columns), edges) for _ in range(models)]
    best = {m: (-math.inf, 0) for m in range(models)}
    growing = set(range(models))
    done = 0
    while growing and done < rounds:
        recent: dict[int, list[list[tuple]]] = {m: [] for m in sorted(growing)}
        for _ in range(min(CHUNK, rounds - done)):
            for m, tree in _tree(spark, rows, len(columns), models, none, weight, recent, depth, rate, alpha, lam, least, allowed).items():
                recent[m].append(tree)
        done += min(CHUNK, rounds - done)
        for m, trees in recent.items():
            out[m].trees += trees
        watched = [m for m in recent if counts[f"held_{m}"]]
        if watched:
            for (m, k), value in sorted(_held_precision(rows, len(columns), models, none, recent, watched).items()):
                nth = len(out[m].trees) - len(recent[m]) + k + 1
                if value > best[m][0] + gain:
                    best[m] = (value, nth)
                elif nth - best[m][1] >= patience:
                    growing.discard(m)
        if growing and done < rounds:
            rows = stage(_moved(rows, len(columns), models, none, recent), "margins")
    for m in range(models):
        if counts[f"held_{m}"]:
            del out[m].trees[max(best[m][1], 1) :]
    return out


def _tree(spark: SparkSession, rows: DataFrame, columns: int, models: int, none: int, weight: list[float], recent: dict, depth: int, rate: float, alpha: float, lam: float, least: float, allowed: list[set[int]] | None) -> dict[int, list[tuple]]:
    """One more tree for each model in `recent`, level by level."""
    leaf = lambda g, h: (-1, 0, False, -1, -1, rate * leaf_value(g / SCALE, h / SCALE, alpha, lam), h / SCALE)
    trees: dict[int, list[tuple]] = {m: [(-1, 0, False, -1, -1, 0.0, 0.0)] for m in recent}
    open_ = {m: [0] for m in recent}
    for level in range(depth):
        if not open_:
            break
        sent = spark.sparkContext.broadcast(_Job(columns, none, weight, recent, trees, open_))
        splits = rows.mapInArrow(_task_sums(sent, models), _SUMS).groupBy("model", "node", "feature").applyInArrow(_best_split(alpha, lam, least, allowed), _SPLITS)
        order = F.struct(F.col("gain"), (-F.col("feature")).alias("f"))
        got = splits.groupBy("model", "node").agg(F.max_by(F.struct("feature", "gain", "cut", "nulls_left", "gl", "hl", "gr", "hr"), order).alias("s")).collect()  # a row a node
        sent.unpersist()
        open_ = {}
        for r in sorted(got, key=lambda r: (r["model"], r["node"])):
            tree, node, s = trees[r["model"]], r["node"], r["s"]
            if level == 0:
                tree[0] = leaf(s["gl"] + s["gr"], s["hl"] + s["hr"])
            if s["gain"] <= LEAST_GAIN:
                continue
            tree[node] = (s["feature"], s["cut"], s["nulls_left"], len(tree), len(tree) + 1, *tree[node][VALUE:])
            open_.setdefault(r["model"], []).extend((len(tree), len(tree) + 1))
            tree += [leaf(s["gl"], s["hl"]), leaf(s["gr"], s["hr"])]
    return trees


def _moved(rows: DataFrame, columns: int, models: int, none: int, recent: dict) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(recent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _all_arrays(sent.value)
        for b in batches:
            x, _, margin, _ = _unpacked(b, columns, models)
            _grown(x, margin, trees, none)
            yield b.set_column(b.schema.get_field_index("margins"), "margins", _packed(margin))

    return rows.mapInArrow(run, rows.schema)


def _held_precision(rows: DataFrame, columns: int, models: int, none: int, recent: dict, watched: list[int]) -> dict[tuple[int, int], float]:
    """Average precision of the held rows of each watched model after each of its recent trees."""
    sent = rows.sparkSession.sparkContext.broadcast({m: recent[m] for m in watched})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _all_arrays(sent.value)
        for b in batches:
            x, y, margin, held = _unpacked(b, columns, models)
            for m, trees in arrays.items():
                mine = np.flatnonzero((held >> np.uint64(m)) & np.uint64(1) == 1)
                for k, t in enumerate(trees):
                    margin[mine, m] += t[VALUE][_leaf(t, x[mine], none)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), m), pa.int32()), pa.array(np.full(len(mine), k), pa.int32()), pa.array(margin[mine, m]), pa.array(y[mine].astype(np.int64))], ["model", "round", "margin", "y"])

    kind = "model int, round int, margin double, y long"
    counts = stage(rows.where("held != 0").mapInArrow(run, kind).groupBy("model", "round", "margin").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "held_scores")
    curve = running_sums(counts, [F.desc("margin")], {"tp": F.col("pos"), "fp": F.col("neg")}, keys=["model", "round"])
    mean = F.round(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos"), 12)
    return {(r["model"], r["round"]): r["ap"] or 0.0 for r in curve.groupBy("model", "round").agg(mean.alias("ap")).collect()}


def margins(model: Boosted, trees: int | None = None):
    """A function of the array of a model's columns (`_vector`): the margin, as a column."""
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        m = sent.value
        none = max((len(e) for e in m.edges), default=0) + 1
        x = _bins(values, [np.array(e) for e in m.edges], none)
        out = np.zeros(len(x))
        for t in map(_arrays, m.trees[:trees]):
            out += t[VALUE][_leaf(t, x, none)]
        return pa.array(out)

    return run


def probability(model: Boosted) -> Column:
    """The chance of a positive, from a model's columns; nulls take each split's learned side."""
    return 1 / (1 + F.exp(-margins(model)(_vector(model.columns))))


def nodes(spark: SparkSession, model: Boosted) -> DataFrame:
    """tree, node, feature, cut, nulls_left, left, right, value, cover: the model as a table; cut is the greatest
    value of the left side (null: all but nulls), feature and cut are null in a leaf."""
    out = []
    for k, tree in enumerate(model.trees):
        for i, (f, cut, nulls, left, right, value, cover) in enumerate(tree):
            inner = f >= 0
            end = float(model.edges[f][cut]) if inner and cut < len(model.edges[f]) else None
            out.append((k, i, model.columns[f] if inner else None, end, nulls if inner else None, left if inner else None, right if inner else None, float(value), float(cover)))
    return spark.createDataFrame(out, "tree long, node long, feature string, cut double, nulls_left boolean, left long, right long, value double, cover double")


# --- contributions


def _paths(tree: list[tuple]) -> list[tuple[float, list[tuple[int, float, list[tuple[int, int, bool, bool]]]]]]:
    """Each leaf: its value, and for each column on its path the share of cover that goes that way and the
    conditions (node's column, cut, nulls left, goes left) a row must meet."""
    out = []

    def walk(node: int, on: dict[int, tuple[float, list]]) -> None:
        f, cut, nulls, left, right, value, cover = tree[node]
        if f < 0:
            out.append((value, [(k, z, c) for k, (z, c) in on.items()]))
            return
        for child, goes_left in ((left, True), (right, False)):
            z, conditions = on.get(f, (1.0, []))
            share = tree[child][COVER] / cover if cover else 0.5
            walk(child, {**on, f: (z * share, [*conditions, (f, cut, nulls, goes_left)])})

    walk(0, {})
    return out


def _shap(paths, x: np.ndarray, none: int, out: np.ndarray) -> None:
    """Adds a tree's Shapley values: over subsets S of a path's columns, those in S go the row's way, the others
    by cover. The product over columns (z + o t) has the sum over subsets of size k as its coefficient of t**k."""
    for value, path in paths:
        if value == 0 or not path:
            continue
        m = len(path)
        meets = []
        for _, _, conditions in path:
            ok = np.ones(len(x), bool)
            for f, cut, nulls, goes_left in conditions:
                b = x[:, f]
                ok &= np.where(b == none, nulls, b <= cut) == goes_left
            meets.append(ok.astype(float))
        size = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for i, (f, z, _) in enumerate(path):
            poly = [np.ones(len(x))]
            for j, (_, zj, _) in enumerate(path):
                if j != i:
                    poly = [(poly[k] * zj if k < len(poly) else 0) + (poly[k - 1] * meets[j] if k else 0) for k in range(len(poly) + 1)]
            out[:, f] += value * (meets[i] - z) * sum(c * w for c, w in zip(poly, size, strict=True))


def _cuts(tree: list[tuple]) -> dict[int, list[int]]:
    """The bins at which a tree cuts each column it uses."""
    out: dict[int, set[int]] = {}
    for f, cut, *_ in tree:
        if f >= 0:
            out.setdefault(f, set()).add(cut)
    return {f: sorted(c) for f, c in out.items()}


def _alike(cuts: dict[int, list[int]], x: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie between the same cuts of a tree go the same ways: one row of each kind, and each row's kind."""
    kind, kinds = np.zeros(len(x), np.int64), 1
    for f, c in cuts.items():
        at = np.where(x[:, f] == none, len(c) + 1, np.searchsorted(c, x[:, f], "left"))
        kind, kinds = kind * (len(c) + 2) + at, kinds * (len(c) + 2)
        if kinds > 1 << 40:  # numbers stay small, however many columns
            kind, kinds = np.unique(kind, return_inverse=True)[1], len(x)
    _, first, of = np.unique(kind, return_index=True, return_inverse=True)
    return first, of


def expectation(model: Boosted) -> float:
    """The margin of a row of which nothing is known: leaves by cover."""
    return math.fsum(value * math.prod(z for _, z, _ in path) for tree in model.trees for value, path in _paths(tree))


def contributions(model: Boosted, df: DataFrame, key: str) -> DataFrame:
    """key, feature, contribution: path-dependent TreeSHAP of the margin, a row for each row and column.

    A row's contributions and the model's expectation add up to its margin. Paths (a table of the trees' size)
    go to the tasks; rows stay distributed.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.edges, [(_paths(t), _cuts(t)) for t in model.trees]))
    columns = list(model.columns)

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        edges, trees = sent.value
        none = max((len(e) for e in edges), default=0) + 1
        x = _bins(values, [np.array(e) for e in edges], none)
        out = np.zeros((len(x), len(edges)))
        for paths, cuts in trees:
            alike, of = _alike(cuts, x, none)
            some = np.zeros((len(alike), len(edges)))
            _shap(paths, x[alike], none, some)
            out += some[of]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(edges), pa.int32()), pa.array(out.ravel()))

    each = df.select(F.col(key), F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), run(_vector(columns)).alias("contribution"))).alias("c"))
    return each.select(key, F.col("c.feature").alias("feature"), F.col("c.contribution").alias("contribution"))


def importance(contribution: DataFrame) -> DataFrame:
    return contribution.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
