"""Operator 3, LM scoring: the marginal probability of a text over its subword lattice.

A word's lattice holds every way to cut it into pieces of an existing vocabulary; each path weighs the
product of its pieces' scores. Beside them is one arc for the whole word, weighted by its training count c:
c / (N + k) against k / (N + k) for the pieces together, with k = V + 1. The forward recursion in log space
sums all of them, so known words are learned and unknown ones are spelled, and the words of a text multiply
to its marginal probability. Add-one smoothing gives the same weight k to what was not seen, spread evenly.

Counts are gathered from all training documents: batches send their distinct words' keys and counts, packed,
to key shards, which add them up and send each batch the totals of its own words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._repeats import shard_bounds, pack_keys, unpack_keys
from yieldspark.llm._spark import staged, table, text_bytes
from yieldspark.llm.language_id import fold

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 8 << 20
MARK = "▁".encode()
ROWS = 16384
#: Words of this many bytes or more go one by one, LONG_SLICE bytes of places at a time.
LONG, LONG_SLICE = 256, 1 << 20
SENT = "shard int, batch long, keys binary, counts binary"
BACK = "shard int, batch long, counts binary, n_tokens long, n_words long"


@dataclass(frozen=True)
class Pieces:
    """Vocabulary pieces as UTF-8 bytes, and log probabilities."""

    texts: tuple[bytes, ...]
    logs: np.ndarray
    bytes_: np.ndarray  # log probability of each single byte's fallback

    @cached_property
    def lengths(self) -> list[int]:
        return sorted({len(t) for t in self.texts})

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two slot tables (the second has what collides in the first) and the pieces' hashes."""
        flat = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(t) for t in self.texts])
        hashes = T.run_hash(T.prefix_hash(T.byte_values(flat)), np.append(0, ends[:-1]), ends)
        first, second = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        order = np.arange(len(hashes), dtype=np.int32)
        first[slot[::-1]] = order[::-1]
        left = order[first[slot] != order]
        second[((hashes[left] >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)] = left
        return first, second, hashes

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash, or -1."""
        first, second, own = self.tables
        at = first[(hashes >> np.uint64(44)).astype(np.int64)]
        at = np.where((at >= 0) & (own[at] == hashes), at, second[((hashes >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return np.where((at >= 0) & (own[at] == hashes), at, -1)


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """The pieces of a sentencepiece model. Its scores order them; where they are ranks (BPE) rather than
    log probabilities, rank r weighs 1 / (r + 3). Byte pieces are the fallback for single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.get_score(i) > -1e8:
            texts.append(model.id_to_piece(i).encode())
            scores.append(model.get_score(i))
    scores = np.array(scores)
    ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    logs = scores if np.exp(scores).sum() > 0.5 else -np.log(ranks + 3.0)
    fallback = np.full(256, logs.min() - np.log(2.0))
    total = np.logaddexp(np.logaddexp.reduce(logs), np.logaddexp.reduce(fallback))
    keep = {t: k for k, t in reversed(list(enumerate(texts)))}
    return Pieces(tuple(keep), logs[list(keep.values())] - total, fallback - total)


def long_lattice(word: np.ndarray, pieces: Pieces) -> float:
    """lattice() of one word of any length: the pieces at all places are found at once, then one pass sums them."""
    n = len(word)
    ends, starts, logs = [np.arange(1, n + 1)], [np.arange(n)], [pieces.bytes_[word]]
    for low in range(0, n, LONG_SLICE):
        part = word[low : low + LONG_SLICE + pieces.lengths[-1]]
        prefix = T.prefix_hash(T.byte_values(part))
        for size in pieces.lengths:
            at = np.arange(min(LONG_SLICE, n - low, max(0, len(part) - size + 1)))
            place = pieces.find(T.run_hash(prefix, at, at + size))
            hit = np.flatnonzero(place >= 0)
            ends.append(low + hit + size)
            starts.append(low + hit)
            logs.append(pieces.logs[place[hit]])
    end = np.concatenate(ends)
    order = np.argsort(end, kind="stable")
    start, log, cuts = np.concatenate(starts)[order].tolist(), np.concatenate(logs)[order].tolist(), np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
    alpha = [0.0] * (n + 1)
    for k in range(n):
        terms = [alpha[start[i]] + log[i] for i in range(cuts[k], cuts[k + 1])]
        most = max(terms)
        alpha[k + 1] = most + math.log(sum([math.exp(t - most) for t in terms]))
    return alpha[n]


def lattice(words: np.ndarray, pieces: Pieces) -> np.ndarray:
    """log of the summed weight of all segmentations; words is a matrix of words of one length, a row each."""
    rows, n = words.shape
    powers = T._power(T._BASE, n), T._power(T._UNBASE, n + 1)
    prefix = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(T.byte_values(words) * powers[0], axis=1, out=prefix[:, 1:])
    alpha = np.full((rows, n + 1), -np.inf)
    alpha[:, 0] = 0
    for end in range(1, n + 1):
        total = alpha[:, end - 1] + pieces.bytes_[words[:, end - 1]]
        for size in pieces.lengths:
            if size > end:
                break
            start = end - size
            place = pieces.find(T.mix((prefix[:, end] - prefix[:, start]) * powers[1][start]))
            hit = np.flatnonzero(place >= 0)
            if len(hit):
                total[hit] = np.logaddexp(total[hit], alpha[hit, start] + pieces.logs[place[hit]])
        alpha[:, end] = total
    return alpha[:, n]


def word_logs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """lattice() of each word, with the word mark before it."""
    out = np.zeros(len(starts))
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    mark = np.frombuffer(MARK, np.uint8)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(size[order[low]])
        if n >= LONG:
            out[order[low:high]] = [long_lattice(np.concatenate([mark, data[starts[w] : ends[w]]]), pieces) for w in order[low:high]]
            continue
        step = max(1, min(ROWS, (1 << 22) // (n + 4)))
        for k in range(low, high, step):
            rows = order[k : min(k + step, high)]
            words = data[starts[rows][:, None] + np.arange(n)]
            out[rows] = lattice(np.concatenate([np.broadcast_to(mark, (len(rows), len(mark))), words], axis=1), pieces)
    return out


def _words(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: lower-cased bytes, each word's start, end and hash, and the documents' first words."""
    parts, base, words = [], 0, 0
    for _, _, data, offsets in T.slices(texts["text"]):
        data = T.LOWER[data]
        starts, ends, first = T.word_bounds(data, offsets)
        parts.append((data, starts + base, ends + base, T.word_hashes(data, starts, ends), first[:-1] + words))
        base, words = base + len(data), words + len(starts)
    columns = list(zip(*parts, strict=True)) if parts else [[np.zeros(0, np.uint8)], *[[np.zeros(0, np.int64)]] * 2, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    data, starts, ends, hashes, first = (np.concatenate(c) for c in columns)
    return data, starts, ends, hashes, np.append(first, words)


def _send(texts: pa.Table, shards: int) -> pa.Table:
    _, _, _, hashes, first = _words(texts)
    learned = np.repeat(texts["learn"].to_numpy(), np.diff(first))
    keys, of = np.unique(hashes, return_inverse=True)
    counts = np.bincount(of, learned, len(keys)).astype(np.uint32)
    at = shard_bounds(keys, shards)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "shard": pa.array(full, pa.int32()),
            "batch": pa.array(np.full(len(full), texts["batch"][0].as_py()), pa.int64()),
            "keys": pa.array([pack_keys(keys[at[s] : at[s + 1]]) for s in full], pa.binary()),
            "counts": pa.array([counts[at[s] : at[s + 1]].tobytes() for s in full], pa.binary()),
        }
    )


def _add_up(sent: pa.Table) -> pa.Table:
    """Total counts of a shard's words, for each batch in its own order; the shard's sums on its first row."""
    parts = [unpack_keys(x) for x in sent["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in sent["counts"].to_pylist()])
    keys, of = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(of, counts, len(keys)).astype(np.int64)
    back = np.split(total[of], np.cumsum([len(p) for p in parts])[:-1])
    sums = lambda n: pa.array([n] + [0] * (len(parts) - 1), pa.int64())
    return pa.table({"shard": sent["shard"], "batch": sent["batch"], "counts": pa.array([x.tobytes() for x in back], pa.binary()), "n_tokens": sums(int(total.sum())), "n_words": sums(int((total > 0).sum()))})


def score_documents(docs: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores every document under counts of the rows where the column `learn` is true.

    Returns doc_id, learn, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (lattice
    model), both log10 of the whole text, a row for each input row. Tokens are A-Z lower-cased words at ASCII
    white space and one end, so a null or empty text is one token. A null `learn` is false. Without training
    rows all counts are 0 and score is the lattice's alone; without training words, half of the base measure
    is the end's. There is no least score: an unknown word's falls with its length. A very long text is scored whole, in its batch; a very long word by
    one pass over its places. Repeated rows count each time; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    batches = max(8, -(-text_bytes(docs, text_col) // BATCH_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    shards = batches
    sent = rows.groupBy("batch").applyInArrow(lambda t: _send(t, shards), SENT)
    back = staged(sent.groupBy("shard").applyInArrow(_add_up, BACK), "counts")
    sums = back.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
    ends = rows.where("learn").count()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    model = spark.sparkContext.broadcast(load_pieces(vocabulary))
    end_share = ends / n if n > ends else 0.5
    base_end = np.log10((ends + 1) / (n + v + 1))
    own_end = np.log10((ends + (v + 1) * end_share) / (n + v + 1))

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        data, starts, ends_, hashes, first = _words(texts)
        keys, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        bounds, c = shard_bounds(keys, shards), np.zeros(len(keys), np.int64)
        for s, packed in zip(counts["shard"].to_pylist(), counts["counts"].to_pylist(), strict=True):
            c[bounds[s] : bounds[s + 1]] = np.frombuffer(packed, np.int64)
        # in log space throughout: a long unknown word's weight has no float
        spelled = np.log((v + 1) * (1 - end_share)) + word_logs(data, starts[at], ends_[at], model.value)
        with np.errstate(divide="ignore"):
            learned = np.log(c)
        base, own = np.log10((c + 1) / (n + v + 1)), (np.logaddexp(learned, spelled) - np.log(n + v + 1)) / np.log(10)
        # each text is summed on its own, so its score does not depend on what else is in the batch
        sums = lambda x: np.where(np.diff(first) > 0, np.add.reduceat(np.append(x[of], 0), first[:-1]), 0)
        return pa.table(
            {
                "doc_id": texts["doc_id"].cast(pa.int64()), "learn": texts["learn"], "n_tokens": pa.array(np.diff(first) + 1, pa.int64()),
                "n_known": pa.array(sums((c > 0).astype(np.int64)) + int(ends > 0), pa.int64()), "train_tokens": pa.array(np.full(texts.num_rows, n), pa.int64()),
                "base_score": pa.array(sums(base) + base_end), "score": pa.array(sums(own) + own_end),
            }
        )

    scored = rows.groupBy("batch").cogroup(back.select("batch", "shard", "counts").groupBy("batch"))
    return scored.applyInArrow(score, "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("learn", F.coalesce(fold("doc_id", 7) != 2, F.lit(True)))
    out = score_documents(docs, "learn")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
