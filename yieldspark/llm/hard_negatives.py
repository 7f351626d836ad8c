"""Operator 11, hard negatives: exact inner-product search over k-means inverted lists with stored radii.

Rows are dealt into the list of their nearest centroid; a list's radius is the largest distance to it, so by
Cauchy-Schwarz a row of the list scores between q.c - |q|r and q.c + |q|r. An anchor visits lists by falling
upper bound, those first that can hold the best, passes over lists that lie outside its window of scores, and
stops where the bound falls strictly below its k-th score. Lists are cut into blocks of bounded size and
anchors into waves, so a tile (block, wave) is one task's work whatever a list holds; a block's best rows
for each anchor are merged by Spark. The results are exact: centroids decide what is skipped, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldspark.llm._spark import staged, table

#: Centroids, and rows of the sample (of least hash) on which they are fitted on the driver.
LISTS, SAMPLE = 64, 4096
#: Rows of a block of a list and anchors of a wave: what one tile holds at most, some MB each.
BLOCK, WAVE = 16_384, 16_384
#: Lists that every anchor visits before its k-th score stops it.
FIRST = 8
#: Scores computed at once.
CELLS = 1 << 20
#: Norms under this give exact products in float64; longer vectors are multiplied as Python integers.
EXACT = 2.0**26
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_HITS = "row long, search int, score long, other long, other_id long"
_ROWS = "row long, vec_id long, label long, list int, distance double, vector binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor(scale * x) as long) of the rows that take part.

    Null ids, labels, vectors and null or non-finite components leave a row out; values beyond 64 bits stop
    at their ends. Other columns are ignored, whatever their names.
    """
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), ints.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List rows as one int64 matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    size = np.diff(ends)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _packed(matrix: np.ndarray) -> pa.Array:
    """A binary for each row: 16-bit numbers where all of the batch fit, else 64-bit ones."""
    small = not matrix.size or (matrix.min() >= -(1 << 15) and matrix.max() < 1 << 15)
    return pa.array([r.tobytes() for r in np.ascontiguousarray(matrix, "<i2" if small else "<i8")], pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    size = np.array([len(r) for r in rows])
    for width, kind in ((2, "<i2"), (8, "<i8")):
        if (at := np.flatnonzero(size == width * dim)).size:
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dim)
    return out


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(1))


def centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds over the sample, from rows spread over it."""
    x = np.unique(sample.astype(np.float64), axis=0)
    means = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = ((means**2).sum(1) - 2 * (x @ means.T)).argmin(1)
        total = np.zeros_like(means)
        np.add.at(total, nearest, x)
        n = np.bincount(nearest, minlength=len(means))
        means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], means)
    return means


class Index:
    """Rows in their lists (staged), the centroids, and each list's radius and number of blocks."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.dim = dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
        picked = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("v").toArrow()["v"]  # SAMPLE vectors
        self.means = means = centroids(_matrix(picked, dim), LISTS) if len(picked) else np.zeros((0, dim))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _matrix(b.column("v"), dim)
                x = m.astype(np.float64)
                far = (means**2).sum(1) - 2 * (x @ means.T)
                nearest = far.argmin(1) if len(x) else np.zeros(0, int)
                distance = np.sqrt(((x - means[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(nearest, pa.int32()), pa.array(distance), _packed(m)], ["row", "vec_id", "label", "list", "distance", "vector"])

        self.rows = staged(rows.mapInArrow(dealt, _ROWS), "lists")
        held = self.rows.groupBy("list").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a list
        self.radius, self.blocks = np.full(len(means), -1.0), np.zeros(len(means), np.int64)
        for r in held:
            self.radius[r["list"]], self.blocks[r["list"]] = r["radius"], -(-r["n"] // BLOCK)
        share = F.create_map(*(F.lit(int(x)) for k, n in enumerate(self.blocks) for x in (k, max(n, 1)))) if len(means) else None
        self.share = share
        self.spark = spark

    def block(self) -> Column:
        return F.pmod(F.xxhash64("row"), F.element_at(self.share, F.col("list")).cast("long")).cast("int")


_VISIT = "row long, label long, vector binary, floors array<long>, tops array<long>, list int, block int, wave int"


def _waved(queries: DataFrame) -> DataFrame:
    """queries with `wave`: about WAVE anchors each, in the order of their own lists, so that those of one wave
    visit much the same lists."""
    counts = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    if not counts:
        return queries.withColumn("wave", F.lit(0))
    held, before, upto = [], [], 0
    for list_, n in sorted(counts.items()):
        held += [F.lit(list_), F.lit(n).cast("long")]
        before += [F.lit(list_), F.lit(upto).cast("long")]
        upto += n
    place = F.element_at(F.create_map(*before), F.col("list")) + F.pmod(F.xxhash64(F.col("row"), F.lit(3)), F.element_at(F.create_map(*held), F.col("list")))
    return queries.withColumn("wave", F.floor(place / WAVE).cast("int"))


def _visits(index: Index, queries: DataFrame, first: bool) -> DataFrame:
    """A row for each anchor and block of a list it has to visit: the best FIRST lists, or all others.

    queries: row, label, vector, wave, floors and tops (the window of each search; a floor is the k-th score so far).
    """
    means, radius, blocks, dim = index.means, index.radius, index.blocks, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpacked(b.column("vector"), dim).astype(np.float64)
            near, reach = x @ means.T, _norms(x)[:, None] * radius
            slack = 1e-9 * (1 + np.abs(near) + reach)  # rounding never skips a list
            upper, lower = near + reach + slack, near - reach - slack
            upper[:, radius < 0] = -np.inf
            order = (-upper).argsort(1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(len(means)), 1)
            open_ = np.zeros(upper.shape, bool)
            for i, (floors, tops) in enumerate(zip(b.column("floors").to_pylist(), b.column("tops").to_pylist(), strict=True)):
                for low, top in zip(floors, tops, strict=True):
                    open_[i] |= (upper[i] >= low) & (lower[i] <= top)
            open_ &= (radius >= 0) & ((rank < FIRST) == first)
            anchor, list_ = np.nonzero(open_)
            times = blocks[list_]
            anchor, list_ = np.repeat(anchor, times), np.repeat(list_, times)
            block = np.arange(len(list_)) - np.repeat(np.cumsum(times) - times, times)
            sent = b.select(["row", "label", "vector", "floors", "tops"])
            for low in range(0, len(anchor), 20_000):
                part = slice(low, low + 20_000)
                yield pa.RecordBatch.from_arrays([*sent.take(pa.array(anchor[part])).columns, pa.array(list_[part], pa.int32()), pa.array(block[part], pa.int32()), b.column("wave").take(pa.array(anchor[part]))], [f.name for f in sent.schema] + ["list", "block", "wave"])

    return queries.select("row", "label", "vector", "wave", "floors", "tops").mapInArrow(run, _VISIT)


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k highest fitting scores of each anchor, earlier rows first in ties."""
    many = np.flatnonzero(fits.sum(1) > k)
    if many.size:
        some = np.where(fits[many], scores[many], -np.inf)
        kth = np.partition(some, -k, axis=1)[:, -k, None]
        above, tie = some > kth, some == kth
        fits[many] = above | (tie & (tie.cumsum(1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(fits)


def _tile(k: int, same_label: bool, dim: int):
    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        ids, other, labels = (rows.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        order = np.lexsort((other, ids))
        ids, other, labels = ids[order], other[order], labels[order]
        x = _unpacked(rows.column("vector"), dim)[order]
        q = _unpacked(visits.column("vector"), dim)
        anchor, own = visits.column("row").to_numpy(), visits.column("label").to_numpy()
        floors, tops = visits.column("floors").to_pylist(), visits.column("tops").to_pylist()
        exact = max(_norms(x).max(initial=0), _norms(q).max(initial=0)) < EXACT
        kind = np.float64 if exact else object
        xt, q = x.astype(kind).T, q.astype(kind)
        found = []
        if len(x):
            for low in range(0, len(q), step := max(1, CELLS // len(x))):
                part = slice(low, low + step)
                scores = q[part] @ xt
                if not exact:
                    scores = np.clip(scores, LOW, HIGH)
                fit = (labels == own[part, None]) == same_label
                fit &= other != anchor[part, None]
                if not exact:
                    at, row = np.nonzero(fit)  # sorted as Python integers, a search at a time
                    found += _wide(scores, at, row, floors[part], tops[part], k, low)
                    continue
                wide = max(map(len, floors[part]), default=0)
                # integers in this range are exact as float64: a window beyond it is open on that side
                bounds = [np.array([f + [HIGH] * (wide - len(f)) for f in side[part]], np.float64).reshape(len(q[part]), wide) for side in (floors, tops)]
                for s in range(wide):
                    used = np.array([s < len(f) for f in floors[part]])
                    at, row = _best(scores, fit & used[:, None] & (scores >= bounds[0][:, s, None]) & (scores <= bounds[1][:, s, None]), k)
                    found.append((at + low, np.full(len(at), s, np.int32), scores[at, row].astype(np.int64), row))
        at, search, score, row = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        return pa.table({"row": anchor[at], "search": pa.array(search, pa.int32()), "score": pa.array(score, pa.int64()), "other": other[row], "other_id": ids[row]})

    return run


def _wide(scores: np.ndarray, at: np.ndarray, row: np.ndarray, floors: list, tops: list, k: int, low: int) -> list[tuple]:
    """The same for scores beyond float64: Python integers, sorted."""
    out = []
    for i in np.unique(at):
        here = row[at == i]
        for s, (floor, top) in enumerate(zip(floors[i], tops[i], strict=True)):
            fit = sorted((-scores[i, j], j) for j in here if floor <= scores[i, j] <= top)[:k]
            out.append((np.full(len(fit), i + low), np.full(len(fit), s, np.int32), np.array([-v for v, _ in fit], np.int64), np.array([j for _, j in fit], np.int64)))
    return out


def _leading(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row", "search").orderBy(F.desc("score"), "other_id", "other")
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """row, search, place (from 1), score, other, other_id: the k best of each search's window, ties by id.

    queries: row, label, vector, list, floors, tops; search s of an anchor takes scores from floors[s] to tops[s]
    of rows with its label, or of the others. Both passes are tiles; the second one visits only lists whose bound
    is not under the k-th score that the first has found. A list goes only to waves that visit it. No queries, or
    an empty index, give no rows.
    """
    if not len(index.means):
        return index.spark.createDataFrame([], f"{_HITS}, place int")
    queries = _waved(queries)
    key = ["list", "block", "wave"]

    def hits(asked: DataFrame, first: bool) -> DataFrame:
        visits = _visits(index, asked, first)
        to = visits.groupBy("list").agg(F.collect_set("wave").alias("waves"))  # a row a list
        rows = index.rows.join(F.broadcast(to), "list")
        dealt = rows.select("row", "vec_id", "label", "vector", "list", index.block().alias("block"), F.explode("waves").alias("wave"))
        return dealt.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_tile(k, same_label, index.dim), _HITS)

    one = staged(_leading(hits(queries, True), k), "first_lists")
    kth = one.where(F.col("place") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("kth"))  # an entry a search
    raised = F.transform("floors", lambda f, s: F.greatest(f, F.coalesce(F.try_element_at(F.col("kth"), s), F.lit(int(LOW)))))
    more = hits(queries.join(kth, "row", "left").select("row", "label", "vector", "wave", raised.alias("floors"), "tops"), False)
    return staged(_leading(one.drop("place").unionByName(more), k), "leading")


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, v (long numbers), as `quantised` gives them; anchors chooses rows (every row whose id is divisible by 100).
    A score is the inner product, ties go to the smaller id; shorter vectors end in zeros, products stop at
    64 bits. An anchor's positives are its best other rows of its label; for each of them the best rows of
    other labels that score within `percent` of it are returned. Rows, not ids, are compared: repeated rows
    are candidates each on their own, and each repeated anchor gives its rows. Anchors without positives or
    without rows in a window give none, as does an empty table.
    """
    index = Index(vectors.select("vec_id", "label", "v"))
    chosen = index.rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors).select("row", "vec_id", "label", "vector", "list")
    whole = lambda v: F.array(F.lit(int(v)).cast("long"))
    pairs = search(index, chosen.select("row", "label", "vector", "list", whole(LOW).alias("floors"), whole(HIGH).alias("tops")), positives, True)
    # integer bounds of percent: scores are whole, so the least one is rounded up and the greatest down
    score, low, top = F.col("score").cast("decimal(38,0)"), *percent
    window = pairs.select("row", F.struct(F.col("place").alias("place"), F.ceil(score * low / 100).cast("decimal(38,0)").alias("floor"), F.floor(score * top / 100).cast("decimal(38,0)").alias("top")).alias("w"))
    each = window.groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("w"))  # `positives` entries
    asked = chosen.join(each, "row").select("row", "label", "vector", "list", F.transform("w", lambda w: w["floor"].cast("long")).alias("floors"), F.transform("w", lambda w: w["top"].cast("long")).alias("tops"))
    found = search(index, asked, negatives, False).select("row", (F.col("search") + 1).alias("nth"), F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = pairs.select("row", F.col("place").alias("nth"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(known, ["row", "nth"]).join(chosen.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy))


ORACLE_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""
