"""Operator 10, suffix-array dedup: blockwise sorting of suffixes with ties resolved by cover ranks.

The cover is content-defined (see _repeats): the samples are the anchors, 1 position in about 85, and every string of
`length` bytes holds one. Unlike with a modular cover, two suffixes that agree on `length` bytes meet at samples at one
offset, which depends on their own bytes only. So suffixes can be dealt by sample, and a sample that stands at one
place only needs no sorting at all. What is left goes in runs (consecutive suffixes of one sample, with the bytes
that their strings span) to shards. A shard

1. ranks its samples by the bytes that follow them, with the prefix that neighbours share,
2. takes one suffix bucket at a time (all suffixes at one offset before their sample), sorts it by the leading bytes
   (those before the sample) and resolves ties by the ranks of the samples,
3. marks the suffixes that share `length` bytes with a neighbour in this order.

A bucket's order holds a few numbers a sample, whatever its ties. Bytes are compared, not hashes. Samples that stand in
FREQUENT batches or more would make one shard too large; their suffixes are dealt and grouped one by one by hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._repeats import Hashed, Plain, Windows, merged_keys, repeated
from yieldspark.llm._spark import table

GRAM = 32
#: Batches that hold a sample from which on its suffixes are dealt one by one.
FREQUENT = 256
#: Runs whose sample is looked for at once.
LOOK = 4096


class Runs(NamedTuple):
    """Runs of a slice: first suffix, suffixes, sample's key, bytes spanned and how many of them are before the sample."""

    at: np.ndarray
    size: np.ndarray
    key: np.ndarray
    spans: list[tuple[bytes, int]]


def find_runs(grams: np.ndarray, starts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows whose leftmost least gram stands at one place: first start, windows, gram's hash."""
    if not len(starts):
        return starts, starts, least
    turn = np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (grams[starts[:-1]] == least[:-1])])
    first = np.flatnonzero(turn)
    return starts[first], np.diff(np.append(first, len(starts))), least[first]


def sample_offsets(grams: np.ndarray, at: np.ndarray, hashes: np.ndarray, span: int) -> np.ndarray:
    """How far after each run's first start its sample is: the first gram with the hash."""
    out = np.zeros(len(at), np.int64)
    for k in range(0, len(at), LOOK):
        near = np.minimum(at[k : k + LOOK, None] + np.arange(span + 1), len(grams) - 1)
        out[k : k + LOOK] = np.argmax(grams[near] == hashes[k : k + LOOK, None], axis=1)
    return out


def ranks(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings cut or filled up to `width`, and the prefix that each shares with the one before (-1 for the first)."""
    fixed = np.array(strings, f"S{width}")
    order = np.argsort(fixed, kind="stable")
    rows = fixed[order].view(np.uint8).reshape(-1, width)
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[-1], shared])


def repeated_suffixes(spans: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each run (distinct bytes, offset of the sample), which of its suffixes share `length` bytes with one of another run."""
    sizes = np.array([len(b) - length + 1 for b, _ in spans])
    before = np.array([n for _, n in spans])
    order, shared = ranks([b[n:] for b, n in spans], length)
    rank = np.empty(len(spans), np.int64)
    rank[order] = np.arange(len(spans))
    deepest = max(1, int(before.max()))
    lead_order, lead_shared = ranks([b[:n][::-1] for b, n in spans], deepest)
    base = np.concatenate([[0], np.cumsum(sizes)])
    marks, lead = np.zeros(base[-1], bool), np.empty(len(spans), np.int64)
    for offset in range(int(before.max()) + 1):
        bucket = np.flatnonzero((before >= offset) & (before - offset < sizes))
        if len(bucket) < 2:
            continue
        lead[lead_order] = np.cumsum(lead_shared < offset)
        tail = np.cumsum(shared < length - offset)
        ordered = bucket[np.argsort(lead[bucket] * len(spans) + rank[bucket])]
        same = (lead[ordered[1:]] == lead[ordered[:-1]]) & (tail[rank[ordered[1:]]] == tail[rank[ordered[:-1]]])
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        ordered = ordered[tied]
        marks[base[ordered] + before[ordered] - offset] = True
    return np.split(marks, base[1:-1])


@dataclass(frozen=True)
class SortedSuffixes(Hashed):
    """The exact pass over runs; shards from `shards` on are those of suffixes dealt by hash."""

    length: int = 200

    def of(self, windows: Windows, data: np.ndarray, pieces: Iterable[tuple], prefilter: Plain, chosen: np.ndarray, often: np.ndarray) -> tuple:
        text, parts, spans, pieces = data.tobytes(), [], [], list(pieces)
        rare = np.setdiff1d(chosen, often, assume_unique=True)
        for low, _, grams, starts, least in pieces:
            at, size, hashes = find_runs(grams, starts, least)
            keys = prefilter.keys(hashes)[0]
            keep = T.is_in(keys, rare)
            at, size, hashes, keys = at[keep], size[keep], hashes[keep], keys[keep]
            offsets = sample_offsets(grams, at, hashes, windows.width - windows.gram)
            parts.append((at + low, size, keys))
            ends = at + size + self.length - 1
            spans += [(text[a:b], n) for a, b, n in zip((at + low).tolist(), (ends + low).tolist(), offsets.tolist(), strict=True)]
        return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)), spans), super().of(windows, data, pieces, prefilter, often, often)

    def distinct(self, found: list[tuple], shards: int) -> dict[int, dict[tuple[bytes, int], int]]:
        """Shard by shard the batch's distinct runs in order, with their counts."""
        out: dict[int, Counter] = {}
        for runs, _ in found:
            for shard, span in zip(shard_of(runs.key, shards).tolist(), runs.spans, strict=True):
                out.setdefault(shard, Counter())[span] += 1
        return {s: dict(sorted(out[s].items())) for s in sorted(out)}

    def send(self, batch: int, found: list[tuple], shards: int) -> pa.Table:
        single = super().send(batch, [x for _, x in found], shards)
        single = single.set_column(0, "shard", pc.add(single["shard"], pa.scalar(shards, pa.int32())))
        own = self.distinct(found, shards)
        sent = {
            "shard": pa.array(list(own), pa.int32()),
            "batch": pa.array([batch] * len(own), pa.int64()),
            "keys": pa.array([pack_runs(list(x)) for x in own.values()], pa.binary()),
            "twice": pa.array([np.packbits([n > 1 for n in x.values()]).tobytes() for x in own.values()], pa.binary()),
        }
        return pa.concat_tables([pa.table(sent), single])

    def merge(self, rows: pa.Table, shards: int) -> list[np.ndarray]:
        if rows["shard"][0].as_py() >= shards:
            return merged_keys(rows)[0]
        places: dict[tuple[bytes, int], int] = {}
        messages, copied = [], set()
        for packed, twice in zip(rows["keys"].to_pylist(), rows["twice"].to_pylist(), strict=True):
            spans = unpack_runs(packed)
            known = len(places)
            mine = [places.setdefault(x, len(places)) for x in spans]
            copied.update(k for k, more in zip(mine, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(mine)).tolist(), strict=True) if more or k < known)
            messages.append(mine)
        marks = repeated_suffixes(list(places), self.length)
        for k in copied:
            marks[k][:] = True
        return [np.concatenate([marks[k] for k in mine]) for mine in messages]

    def hits(self, found: list[tuple], back: pa.Table, shards: int) -> list[np.ndarray]:
        single = back.filter(pc.greater_equal(back["shard"], shards))
        single = single.set_column(single.column_names.index("shard"), "shard", pc.subtract(single["shard"], pa.scalar(shards, pa.int32())))
        out = super().hits([x for _, x in found], single, shards)
        bits = {s: b for r, s, b in zip(*(back[c].to_pylist() for c in ("round", "shard", "bits")), strict=True) if r == 2 and s < shards}
        marks: dict[tuple[bytes, int], np.ndarray] = {}
        for shard, own in self.distinct(found, shards).items():
            if shard in bits:
                cuts = np.cumsum([len(b) - self.length + 1 for b, _ in own])
                flat = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=cuts[-1]).astype(bool)
                marks.update(zip(own, np.split(flat, cuts[:-1]), strict=True))
        for k, (runs, _) in enumerate(found):
            own = [at + np.flatnonzero(marks[x]) for at, x in zip(runs.at.tolist(), runs.spans, strict=True) if x in marks]
            out[k] = np.concatenate([out[k], *own])
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def pack_runs(spans: list[tuple[bytes, int]]) -> bytes:
    """Number of runs, their lengths and offsets of samples, and their bytes."""
    sizes = np.array([(len(b), n) for b, n in spans], np.uint32)
    return np.uint32(len(spans)).tobytes() + sizes.tobytes() + b"".join(b for b, _ in spans)


def unpack_runs(packed: bytes) -> list[tuple[bytes, int]]:
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    sizes = np.frombuffer(packed, np.uint32, 2 * n, 4).reshape(-1, 2)
    ends = (4 + 8 * n + np.cumsum(sizes[:, 0])).tolist()
    return [(packed[e - size : e], offset) for e, (size, offset) in zip(ends, sizes.tolist(), strict=True)]


def _keep(text: bytes, removed: np.ndarray) -> tuple[int, int, int, bytes]:
    n = int(removed.sum())
    if not n:
        return len(text), 0, 0, text
    spans = int(np.count_nonzero(removed[1:] & ~removed[:-1])) + int(removed[0])
    return len(text), n, spans, np.frombuffer(text, np.uint8)[~removed].tobytes()


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Removes each UTF-8 byte inside a string of `length` bytes that also starts elsewhere in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary, as a cut may fall inside a character), a
    row for each input row. Null and empty texts have no bytes; strings never cross documents; the same
    row twice is a repeat of itself; a very long text goes through in pieces, with a mask of its bytes; other columns are ignored; an empty table gives none.
    """
    windows = Windows(length, min(GRAM, length), words=False)
    return repeated(docs, id_col, text_col, windows, lambda total: Plain(), _keep, "n_bytes long, n_removed long, n_spans long, kept binary", SortedSuffixes(FREQUENT, length))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
