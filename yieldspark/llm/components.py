"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldspark.llm._spark import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x != y")
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.select("x", F.col("m").alias("y"))).where("x != y").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of the edges x, y; loops and repeats are fine.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges, before = edges.select("x", "y"), None
    while True:
        edges = staged(_small_star(_large_star(edges)), "stars")
        # not an observation of the write: once a session has observed, models of Spark ML no longer serialise in it
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before or not now["n"]:
            break
        before = now
    roots = edges.select(F.col("y").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(roots)


def grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, label) after more links x, y; staged. Only labels that the links join are run anew."""
    if labels is None:
        return staged(connected_components(links), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    fresh = links.select("x", "y").join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    fresh = staged(fresh.where("x != y").distinct(), "fresh")
    if fresh.isEmpty():
        return labels
    moved = staged(connected_components(fresh), "moved").select(F.col("node").alias("label"), F.col("label").alias("to"))
    # a node that no link had yet is its own label
    known = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = moved.join(labels, moved["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return staged(known.unionByName(new), "labels")
