"""Sums of products over pairs of columns, in blocks: a row a block and task, merged in two steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block, and lanes in which the tasks' blocks are merged first.
BLOCK, LANES = 64, 64
_BLOCKS = "i int, j int, lane int, sums binary"


def block_sums(df: DataFrame, columns: list[str], products: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """i, j, sums: `products` of blocks i <= j of columns, summed over all rows.

    products takes two blocks of values (rows x columns, NaN where null) and gives float matrices, one behind
    the other. A task holds all blocks (columns squared); 10,000 tasks of 590 columns send 55 rows each.
    """
    k = len(columns)
    cuts = [slice(low, min(low + BLOCK, k)) for low in range(0, k, BLOCK)]
    values = F.array(*(F.when(~F.isnan(c), c) for c in (F.col(c).cast("double") for c in columns))).alias("x")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
            for i, a in enumerate(cuts):
                for j in range(i, len(cuts)):
                    sums[i, j] = sums.get((i, j), 0) + products(x[:, a], x[:, cuts[j]])
        lane = TaskContext.get().partitionId() % LANES
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sums], pa.int32()), pa.array([j for _, j in sums], pa.int32()), pa.array([lane] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["i", "j", "lane", "sums"])

    def merged(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s) for s in part.column("sums").to_pylist())
        return part.slice(0, 1).set_column(part.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    parts = df.select(values).mapInArrow(partial, _BLOCKS)
    return parts.groupBy("i", "j", "lane").applyInArrow(merged, _BLOCKS).groupBy("i", "j").applyInArrow(merged, _BLOCKS).drop("lane")


def pair_sums(df: DataFrame, columns: list[str], products: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """i <= j (numbers of columns) and the sums of `products`, a column for each of its matrices."""
    k = len(columns)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bi, bj, sums in zip(*(b.column(c).to_pylist() for c in ("i", "j", "sums")), strict=True):
                high, wide = min(BLOCK, k - bi * BLOCK), min(BLOCK, k - bj * BLOCK)
                m = np.frombuffer(sums).reshape(len(names), high, wide)
                i, j = np.indices((high, wide)).reshape(2, -1) + np.array([[bi], [bj]]) * BLOCK
                keep = i <= j
                yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *(pa.array(v.ravel()[keep]) for v in m)], ["i", "j", *names])

    return block_sums(df, columns, products).mapInArrow(cells, "i int, j int, " + ", ".join(f"{n} double" for n in names))


def known_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """i <= j, n: rows on which both columns are known."""
    return pair_sums(df, columns, lambda a, b: ((~np.isnan(a)).astype(float).T @ (~np.isnan(b)).astype(float))[None], ["n"])


def mean_and_covariance(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows on which all columns are known, their means and sample covariance (columns squared, on the driver)."""
    whole = df.dropna(subset=columns)
    row = whole.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    n, k = row["n"], len(columns)
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    cov = np.zeros((k, k))
    centred = whole.select(*((F.col(c).cast("double") - F.lit(float(m))).alias(c) for c, m in zip(columns, mean, strict=True)))
    for r in pair_sums(centred, columns, lambda a, b: (a.T @ b)[None], ["s"]).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / max(n - 1, 1)
    return n, mean, cov
