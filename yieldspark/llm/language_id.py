"""Operator 2, language ID: a blended-spectrum string kernel with Nyström landmarks.

A text is the set of its byte n-grams of 1 to 4 (lower-cased), hashed to `DIMS` bits: presence only. The
kernel of two texts is the cosine of their presence vectors. `landmarks` texts span the Nyström map, and
one-versus-rest kernel ridge regression is solved on a bounded sample of labelled rows. Scoring multiplies
the sparse presence rows of a batch with (landmarks' presence @ Nyström map @ ridge weights), which is one
DIMS x languages matrix: the products associate, so no row meets the landmarks one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import row_of, table

DIMS_BITS = 17
DIMS = 1 << DIMS_BITS
ORDERS = (1, 2, 3, 4)
#: Bytes of the presence bitmaps that are unpacked at once.
BLOCK = 512
#: Texts that are multiplied at once.
TEXTS = 64
PAIR = pa.schema({"lang": pa.string(), "grams": pa.binary()})


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # DIMS x languages, float32


def gram_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed codes of all n-grams of lower-cased bytes, order by order; white space counts as one blank."""
    x = np.where(T.SPACE[data], np.uint8(0x20), T.LOWER[data]).astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        if n in ORDERS:
            yield ((code + np.uint32(n * 0x9E3779B1 % (1 << 32))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIMS_BITS)


def _presence(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    flags[:] = False
    for codes in gram_codes(data):
        flags[codes] = True
    return np.flatnonzero(flags)


def _products(found: list[np.ndarray], weights: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Scores of a block of texts (their grams): presence matrix, over the grams that occur, times weights."""
    sizes, grams = np.array([len(x) for x in found]), np.concatenate(found)
    flags[:] = False
    flags[grams] = True
    own = np.flatnonzero(flags)
    presence = np.zeros((len(found), len(own)), np.float32)
    presence[np.repeat(np.arange(len(found)), sizes), np.searchsorted(own, grams)] = 1
    return presence @ weights[own] / np.sqrt(np.maximum(sizes, 1))[:, None]


def _sampled(docs: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """Up to rows // languages different labelled texts of each language: the least by a hash of the text.

    A language of many texts is first thinned by the same hash to about four quotas, so that few rows are
    ranked in one task, however many it has; copies of one text are one row before that.
    """
    quota = max(1, rows // len(counts))
    share = {lang: min(1.0, (4 * quota + 64) / max(n, 1)) for lang, n in counts.items()}
    most = {lang: min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)) for lang, s in share.items()}
    drawn = docs.select("lang", "text", F.xxhash64("text", F.lit(17)).alias("drawn")).where(F.col("drawn") <= F.create_map(*(F.lit(x) for kv in most.items() for x in kv))[F.col("lang")])
    drawn = drawn.groupBy("lang", "drawn").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("drawn")
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).drop("place", "drawn")


def fit(docs: DataFrame, rows: int = 1200, landmarks: int = 256, ridge: float = 1e-3) -> LanguageModel | None:
    """Fits on at most `rows` labelled texts (text, lang); None if there are none.

    Rows without text or lang are left out; ids are not read; copies count once, so the sample is the same
    however rows repeat. Empty texts have no grams; of very long ones all grams count. What comes to the
    driver is one presence bitmap (16 KB) for each of these texts, so `rows` bounds it; with more than `rows`
    languages, those of the most texts are learned.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = docs.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(17))).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return None
    sizes = {r["lang"]: r["n"] for r in counts}
    languages = tuple(sorted(sizes))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(DIMS, bool)
        for b in batches:
            packed = []
            for text in T.binary(b.column("text")).to_pylist():
                _presence(np.frombuffer(text, np.uint8), flags)
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(packed, pa.binary())], schema=PAIR)

    known = docs.where(F.col("lang").isin(*languages)) if len(languages) == rows else docs
    sample = _sampled(known, sizes, rows).select("lang", "text").mapInArrow(grams, "lang string, grams binary")
    got = sorted((r["lang"], bytes(r["grams"])) for r in sample.collect())
    if not got:
        return None
    bits = np.frombuffer(b"".join(g for _, g in got), np.uint8).reshape(len(got), -1)
    spread = np.random.default_rng(7).permutation(len(got))[: min(landmarks, len(got))]
    kernel, size = np.zeros((len(got), len(spread))), np.zeros(len(got))
    for low in range(0, bits.shape[1], BLOCK):
        part = np.unpackbits(bits[:, low : low + BLOCK], axis=1).astype(np.float32)
        kernel += part @ part[spread].T
        size += part.sum(1)
    norm = np.sqrt(np.maximum(size, 1))
    kernel /= norm[:, None] * norm[spread]
    y = (np.array([g for g, _ in got])[:, None] == np.array(languages)).astype(float)
    values, vectors = np.linalg.eigh(kernel[spread])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ root
    solved = np.linalg.solve(z.T @ z + ridge * len(got) * np.eye(z.shape[1]), z.T @ y)
    dual = (root @ solved) / norm[spread][:, None]
    weights = np.concatenate([np.unpackbits(bits[spread, low : low + BLOCK], axis=1).T.astype(np.float32) @ dual for low in range(0, bits.shape[1], BLOCK)])
    return LanguageModel(languages, np.ascontiguousarray(weights, np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: margin of the best language over the next), a row for each input row.

    `und` with score 0 for null texts, texts without a letter, and where no model could be learned. A very
    long text is read whole, one slice of its own.
    With carry, the input row comes along as a struct `row`. Repeated rows give repeated rows; other columns
    are ignored; an empty table gives none.
    """
    row, kind = row_of(docs)
    text = F.col(text_col).cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(lettered, text).alias("text"), *([row] if carry else []))
    more = ["row"] if carry else []
    if model is None:
        return rows.select(*more, "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, flags = sent.value.languages, sent.value.weights, np.zeros(DIMS, bool)
        for batch in batches:
            n = batch.num_rows
            scores = np.zeros((n, len(names)), np.float32)
            for row, end, data, offsets in T.slices(batch.column("text")):
                for low in range(0, end - row, TEXTS):
                    high = min(low + TEXTS, end - row)
                    found = [_presence(data[offsets[i] : offsets[i + 1]], flags) for i in range(low, high)]
                    scores[row + low : row + high] = _products(found, weights, flags)
            best = scores.argmax(1)
            top = np.take_along_axis(scores, best[:, None], 1)[:, 0]
            rest = np.where(np.arange(len(names)) == best[:, None], -np.inf, scores).max(1, initial=-1.0)
            absent = np.diff(T.buffers(T.binary(batch.column("text")))[1]) == 0
            lang = np.where(absent, "und", np.array(names, object)[best])
            sure = np.where(absent, 0.0, np.clip(top - rest, 0.0, 1.0).astype(float))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*more, "doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {kind}, " * carry + "doc_id long, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where(F.coalesce(fold("doc_id", 3) != 1, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = predict(docs, fit(learn))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
