"""Operator 7, MinHash near-dedup: HyperMinHash registers, banded, estimated, then verified on full sets.

A document is its set of word shingles. Each set gets `BUCKETS` registers: of the least hash in a bucket,
the count of leading zeros (6 bits) and the next `MANTISSA` bits. Documents with equal sets collapse into
one node first. Bands of registers give candidate buckets; each bucket links its members to its pivot only
(a star, not all pairs): pairs far under the threshold by the collision-corrected estimate go, the others
are verified on full sets. Where a star still holds several components, two members may link though neither
links with the pivot, or one does. Such members share shingles by which they differ from the pivot, so they
meet again in narrower buckets of those: small ones are compared pair by pair, wide ones by another star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import row_of, staged, table
from yieldspark.llm.components import grown

BUCKETS, MANTISSA = 192, 10
#: A link at the threshold is missed by all bands less often than this.
MISS = 1e-6
ROW_SLICE = 1024
#: Narrowed buckets of up to PAIRED members are compared pair by pair, so a member meets at most that many;
#: wider ones get another star. What ROUNDS of stars have not narrowed is compared in blocks of PAIRED.
PAIRED, ROUNDS = 1024, 5
#: Ids of candidates that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
NODES = "doc_id long, place long, n_shingles long, node long, registers binary"
_EMPTY = np.iinfo(np.uint64).max


def band_rows(percent: int) -> int:
    """The most registers a band can have under MISS at this threshold."""
    t = percent / 100
    return max(r for r in range(1, 13) if (1 - t**r) ** (BUCKETS // r) < MISS or r == 1)


def shingle_sets(column: pa.ChunkedArray | pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct 52-bit shingle hashes, sorted in each document, and their bounds by document."""
    for row, end, data, offsets in T.slices(column):
        for low in range(0, end - row, ROW_SLICE):
            cut = offsets[low : low + ROW_SLICE + 1]
            starts, ends, first = T.word_bounds(part := T.LOWER[data[cut[0] : cut[-1]]], cut - cut[0])
            prefix = T.prefix_hash(T.word_hashes(part, starts, ends) | np.uint64(1))
            at = np.flatnonzero(T.window_starts(first, size))
            docs = np.searchsorted(first, at, "right") - 1
            words = np.diff(first)
            short = np.flatnonzero((words > 0) & (words < size))
            hashes = np.concatenate([T.run_hash(prefix, at, at + size), T.run_hash(prefix, first[short], first[short + 1])])
            docs = np.concatenate([docs, short]).astype(np.uint64)
            keys = np.sort((docs << np.uint64(52)) | (hashes >> np.uint64(12)))
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
            bounds = np.searchsorted(keys, np.arange(len(cut), dtype=np.uint64) << np.uint64(52))
            yield keys & np.uint64((1 << 52) - 1), bounds


def hyper_registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint16 registers, a row for each non-empty set; empty buckets borrow from others by one shared rule."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = T.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    least = np.full((len(bounds) - 1) * BUCKETS, _EMPTY, np.uint64)
    np.minimum.at(least, docs * BUCKETS + bucket.astype(np.int64), T.mix(hashes + np.uint64(0x51ED270B)) >> np.uint64(1))
    least = least.reshape(-1, BUCKETS)
    d, b = np.nonzero((least == _EMPTY) & (np.diff(bounds) > 0)[:, None])
    have, turn = least.copy(), 1
    while len(d):
        donor = (T.mix((b.astype(np.uint64) << np.uint64(20)) + np.uint64(turn)) % np.uint64(BUCKETS)).astype(np.int64)
        value = have[d, donor]
        least[d, b] = np.where(value == _EMPTY, _EMPTY, value)
        left = value == _EMPTY
        d, b, turn = d[left], b[left], turn + 1
    # 63-bit values as floats: exponent and leading fraction are the zero count and the mantissa
    fraction, exponent = np.frexp(least.astype(np.float64) + 1)
    zeros = np.clip(63 - exponent, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def _set_hash(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set: a sum over its shingles, mixed with its size."""
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(T.mix(shingles + np.uint64(0xD1B54A32D192ED03)), out=sums[1:])
    return T.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for shingles, bounds in shingle_sets(batch.column("text"), size):
                n = np.diff(bounds)
                registers = hyper_registers(shingles, bounds)
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, rows),
                        batch.column("place").slice(row, rows),
                        pa.array(n),
                        pa.array(_set_hash(shingles, bounds), mask=n == 0),
                        pa.array([r.tobytes() if k else None for r, k in zip(registers, n, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "place", "n_shingles", "node", "registers"],
                )
                row += rows

    return docs.mapInArrow(run, NODES)


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs with `near` (they may link) and `beside` (x may have a link that also links with y), both up to
    six standard errors of the corrected estimate: two links in a row leave at least 2 t - 1 of similarity."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("rx", "ry"))
            nx, ny = (b.column(c).to_numpy().astype(float) for c in ("nx", "ny"))
            ratio = np.maximum(nx, ny) / np.minimum(nx, ny)
            chance = 0.1699 * 2.0 ** (1 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
            jaccard = ((x == y).mean(1) - chance) / (1 - chance)
            error = np.sqrt(t * (1 - t) / np.minimum(BUCKETS, np.minimum(nx, ny)))
            near = (jaccard >= t - 6 * error) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
            beside = (jaccard >= 2 * t - 1 - 6 * error) & (1 >= (2 * t - 1) * ratio)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(near), pa.array(beside)], ["x", "y", "near", "beside"])

    return pairs.mapInArrow(run, "x long, y long, near boolean, beside boolean")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, beside) with `linked`; those not near by the estimate are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                found = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(part.column("sx").to_pylist(), part.column("sy").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("x", "y", "beside")), pa.array(found, pa.bool_())], ["x", "y", "beside", "linked"])

    near = pairs.where("near").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y").join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
    near = near.select("x", "y", "beside", "sx", "sy").mapInArrow(run, "x long, y long, beside boolean, linked boolean")
    return near.unionByName(pairs.where("not near").select("x", "y", "beside", F.lit(False).alias("linked")))


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of the nodes (node, doc_id of one of its documents), from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shingles, bounds in shingle_sets(batch.column("text"), size):
                packed = [shingles[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                some = pa.array(np.diff(bounds) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(shingles, bounds)), pa.array(packed, pa.binary())], ["node", "shingles"]).filter(some)

    wanted = staged(nodes.select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text")
    return texts.mapInArrow(run, "node long, shingles binary").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _buckets(members: DataFrame) -> DataFrame:
    """(key, node) rows with n, the bucket's size, and its pivot: the member whose buckets are the largest in sum.

    A group of copies of one original has it (or its nearest copy) as pivot, as most bands agree with it.
    """
    sized = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    central = sized.groupBy("node").agg(F.sum("n").alias("central"))
    ranked = sized.join(central, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct(F.col("central"), (-F.col("node")).alias("least"), F.col("node")))["node"].alias("pivot"))
    return sized.join(pivots, "key")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, diff): shingles that only one of the two sets has; x, y and their other columns stay."""
    own = [c for c in pairs.columns if c not in ("x", "y")]
    kinds = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                bags = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column("sx").to_pylist(), part.column("sy").to_pylist(), strict=True)]
                diffs = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in bags]
                flat = pa.array(np.concatenate(diffs) if diffs else np.zeros(0, np.int64))
                ends = pa.array(np.cumsum([0, *(len(d) for d in diffs)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("x", "y", *own)), pa.array([len(x) for x, _ in bags], pa.int64()), pa.array([len(y) for _, y in bags], pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                    ["x", "y", *own, "nx", "ny", "diff"],
                )

    joined = pairs.join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y").join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
    return joined.select("x", "y", *own, "sx", "sy").mapInArrow(run, f"x long, y long{kinds}, nx long, ny long, diff array<long>")


def _narrowed(star: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Buckets (key, y, label, linked, f, left, n) that hold every pair which may still link two components, of a
    star's groups (None if no group has two that might); left: the elements of y from the bucket's on, which bound what a pair that meets here first shares.

    star has (x, y, beside, linked): pivot, member, and what is known of the two. Let d(z) be the
    shingles which only one of z and its pivot has. Two members link if the sets d share at least
    (f(y) + f(z)) / 2 elements, where f(z) = |d(z)| - theta |z| and theta = (100 - percent) / (100 + percent);
    with one of them not linked to the pivot that is over 0. So they meet in a bucket of (pivot, element), of
    elements that several components have, and by the usual argument already in those of the rarest elements
    of each, as many as it has over that least overlap, plus one. Members that have fewer go altogether.
    """
    theta = (100 - percent) / (100 + percent)
    members = star.join(labels.select(F.col("node").alias("y"), "label"), "y", "left").withColumn("label", F.coalesce("label", "y"))
    own, other = (lambda c: F.when(F.col("linked"), F.col(c))), (lambda c: F.when(~F.col("linked"), F.col(c)))
    near = F.when(F.col("beside") & ~F.col("linked"), F.col("label"))
    spread = members.groupBy("x").agg(F.max(own("label")).alias("own"), F.min(near).alias("a"), F.max(near).alias("b"), F.min(other("label")).alias("low"), F.max(other("label")).alias("high"))
    # what is not beside the pivot links with nothing that links with the pivot
    open_ = spread.select("x", F.coalesce((F.col("a") != F.col("own")) | (F.col("b") != F.col("own")), F.lit(False)).alias("both"), (F.col("low") != F.col("high")).alias("many")).where("both or many")
    open_ = staged(open_, "groups")
    if open_.isEmpty():
        return None
    members = members.join(open_, "x").where("both or not linked").drop("beside", "both", "many")
    found = staged(_differences(members, sets).withColumn("f", F.size("diff") - theta * F.col("ny")), "differences")
    elements = found.select("x", "y", "label", F.explode("diff").alias("e"))
    shared = elements.groupBy("x", "e").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("x", "e", "n")
    rare = elements.join(shared, ["x", "e"]).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("rare"))
    rows = found.select("x", "y", "label", "linked", "f").join(rare, ["x", "y"]).withColumn("g", F.size("rare") - F.col("f") / 2)
    rows = staged(rows, "rare")
    least = F.ceil((F.col("f") + F.when(F.col("linked"), F.col("f_other")).otherwise(F.least("f_other", "f_own"))) / 2 - 1e-6)
    for _ in range(2):
        bounds = rows.groupBy("x").agg(
            F.min(own("f")).alias("f_own"), F.min(other("f")).alias("f_other"), F.max("g").alias("g_all"), F.max(other("g")).alias("g_other"), F.min("label").alias("low"), F.max("label").alias("high"),
        ).where("low != high and f_other is not null").drop("low", "high")
        partner = F.col("f") / 2 <= F.when(F.col("linked"), F.col("g_other")).otherwise(F.col("g_all")) + 1e-6
        rows = rows.drop("overlap").join(bounds, "x").withColumn("overlap", F.greatest(least, F.lit(1)).cast("int"))
        rows = staged(rows.where(partner & (F.size("rare") >= F.col("overlap"))).drop("f_own", "f_other", "g_all", "g_other"), "open")
    rarest = F.slice("rare", F.lit(1), F.size("rare") - F.col("overlap") + 1)
    at = F.posexplode(F.transform(rarest, lambda s: F.xxhash64("x", s["e"]))).alias("at", "key")
    cells = rows.select("y", "label", "linked", "f", F.size("rare").alias("held"), at)
    cells = staged(cells.select("key", "y", "label", "linked", "f", (F.col("held") - F.col("at")).alias("left")), "cells")
    wide = cells.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("linked").alias("linked"), F.bit_xor(F.xxhash64("y")).alias("members"), F.count(F.lit(1)).alias("n"))
    # buckets of the same members are one
    wide = wide.where("low != high and not linked").groupBy("members").agg(F.min(F.struct("key", "n")).alias("first")).select("first.*")
    return staged(cells.join(wide, "key"), "narrowed")


def _paired(cells: DataFrame) -> DataFrame:
    """The pairs x < y of a narrowed bucket that may link two components, its members met by blocks of PAIRED."""
    blocks = F.ceil(F.col("n") / PAIRED).cast("int")
    one = cells.select("key", F.col("y").alias("x"), F.col("label").alias("of"), F.col("linked").alias("done"), F.col("f").alias("fx"), F.col("left").alias("most"), F.pmod(F.xxhash64("y"), blocks).cast("int").alias("block"))
    two = cells.select("key", "y", "label", "linked", "f", "left", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    may = "x < y and of != label and not (done and linked) and 2 * least(most, left) >= f + fx - 0.000001"
    return one.join(two, ["key", "block"]).where(may).select("x", "y").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id), a row
    for each input row. Words are split at ASCII white space and A-Z lower-cased; a text under `shingle`
    words is one shingle; null, empty and blank texts link with nothing and are kept. Rows of one text link
    whatever their ids. A null id is kept if its component has no other id. Other columns are ignored. The
    set of a very long text is built from the whole of it, in pieces; it is one row of 8 bytes a shingle.
    """
    return _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("place")), shingle, percent).drop("place", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The input rows, one for each component of near_duplicates: that of the least doc_id, a null id after all others.

    Decided by row, whatever ids the rows share; of repeated rows one stays. Rows without a word all stay.
    Input columns come out as they are, whatever their names; an empty table gives none. Rows are staged
    with a number, by which alone they are compared and kept; a very long text is read whole, twice.
    """
    row, _ = row_of(docs)
    rows = staged(docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place")), "rows")
    found = staged(_components(rows.select("doc_id", F.col("row")[text_col].cast("string").alias("text"), "place"), shingle, percent).select("doc_id", "place", "label"), "found")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))["place"].alias("place"))
    kept = found.where("label is null").select("place").unionByName(first.select("place"))
    return rows.select("row", "place").join(kept, "place", "left_semi").select("row.*")


def _components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, place, n_shingles, component_id, label (null without shingles) and kept, of doc_id, text and place."""
    sketched = staged(_sketch(docs, shingle), "sketch")
    rows = band_rows(percent)
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    nodes = staged(nodes, "nodes")
    # a smaller set equals all that it links with
    banded = nodes.where(F.col("n") * (100 - percent) >= percent).select("node", "registers")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // rows - 1)), lambda k: F.xxhash64(k, F.substring("registers", k * F.lit(2 * rows) + 1, F.lit(2 * rows))))
    hits = staged(_buckets(banded.select("node", F.explode(bands).alias("key"))), "hits")
    wanted = nodes.join(hits.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    sets = staged(_sets(docs, wanted, shingle), "sets")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "nx", "ny", "rx", "ry")
        return staged(_verified(staged(_estimated(both, percent), "estimated"), sets, percent), "compared")

    labels = None
    for turn in range(ROUNDS):
        star = compared(hits.where("node != pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct())
        labels = grown(labels, star.where("linked"))
        cells = _narrowed(star, labels, sets, percent)
        if cells is None:
            break
        labels = grown(labels, compared(_paired(cells if turn == ROUNDS - 1 else cells.where(F.col("n") <= PAIRED))).where("linked"))
        cells = cells.where(F.col("n") > PAIRED).select("key", F.col("y").alias("node"))
        if cells.isEmpty():
            break
        hits = staged(_buckets(cells), "hits")

    of = nodes.select("node", F.col("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    out = sketched.join(of.select("node", "label").join(least, "label"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "place", "n_shingles", component.alias("component_id"), "label")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
