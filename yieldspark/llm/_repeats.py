"""Which windows of a corpus start at two or more places, found without moving a row for each window.

Documents are dealt into batches by a hash of their id. A batch sends its distinct 64-bit window keys,
packed, to key shards (a window that a third of all documents hold comes once from each batch); a shard
merges what it gets and sends back one bit a key. Two rounds keep this small:

1. Anchors. The window's anchor is its least hashed gram of `gram` elements, so equal windows have equal
   anchors at one offset: a content-defined difference cover, of density 2 / (window - gram + 2). A
   window whose anchor stands at one place only cannot repeat. What is sent of the anchors is up to the
   prefilter: the anchors themselves (Plain), or the cells of a count-min sketch of the batch.
2. Windows. Only those with a repeated anchor are grouped exactly: by their own hash (Hashed), or as the
   exact pass that an operator brings says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import text_bytes

#: A batch's bytes; from BATCH_BYTES * BATCHES on it grows with the corpus up to MOST_BYTES, as messages get short.
BATCH_BYTES, MOST_BYTES, BATCHES = 4 << 20, 16 << 20, 4096
#: A batch is over KEEP_BYTES only where one text is very long; elements are scanned PIECE_ELEMENTS at a time.
KEEP_BYTES = 12 << 20
PIECE_ELEMENTS = 2 << 20
SENT = "shard int, batch long, keys binary, twice binary"
BACK = "batch long, round int, shard int, bits binary"


@dataclass(frozen=True)
class Plain:
    """A prefilter that sends a key for each anchor. shift: low bits of its keys that are always 0."""

    shift: int = 0

    def keys(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The keys whose counts must all be 2 or more for the anchor to count as repeated. Anchors are least
        hashes, all of them small: mixed anew, they spread over the shards."""
        return [T.mix(hashes)]


@dataclass(frozen=True)
class Windows:
    """Windows of `width` elements, anchored by grams of `gram`; an element is a word or a byte."""

    width: int
    gram: int
    words: bool

    def elements(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return T.byte_values(data), offsets
        starts, ends, first = T.word_bounds(data, offsets)
        return T.word_hashes(data, starts, ends) | np.uint64(1), first

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each piece: its first element, and what scan_elements says. Only a text over PIECE_ELEMENTS has
        several; neighbours overlap by a window less one, so each window starts in one piece."""
        if not self.words and len(data) > PIECE_ELEMENTS:
            for low in range(0, max(1, len(data) - self.width + 1), PIECE_ELEMENTS):
                part = data[low : low + PIECE_ELEMENTS + self.width - 1]
                yield low, *self.scan_elements(T.byte_values(part), np.array([0, len(part)]))
            return
        values, first = self.elements(data, offsets)
        if len(values) <= PIECE_ELEMENTS:
            yield 0, *self.scan_elements(values, first)
            return
        for low in range(0, max(1, len(values) - self.width + 1), PIECE_ELEMENTS):
            high = min(len(values), low + PIECE_ELEMENTS + self.width - 1)
            yield low, *self.scan_elements(values[low:high], np.clip(first, low, high) - low)

    def scan_elements(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix hashes, gram hashes, each valid window's start and its anchor's hash."""
        prefix, n = T.prefix_hash(values), len(values)
        if n < self.width:
            return prefix, prefix[:0], np.zeros(0, np.int64), prefix[:0]
        grams = T.run_hash(prefix, slice(0, n - self.gram + 1), slice(self.gram, n + 1)) | np.uint64(1)
        starts = np.flatnonzero(T.window_starts(first, self.width))
        return prefix, grams, starts, T.sliding(grams, self.width - self.gram + 1, np.minimum)[starts]

    def anchors(self, grams: np.ndarray, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The hash at every position that anchors some window (all positions of a tie)."""
        span = self.width - self.gram
        if not len(starts):
            return grams[:0]
        at = np.zeros(len(grams) + span, np.uint64)
        at[starts + span] = least
        return grams[T.sliding(at, span + 1, np.maximum) == grams]

    def candidates(self, prefix: np.ndarray, starts: np.ndarray, least: np.ndarray, prefilter: Plain, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows whose anchor has all its keys among the sorted chosen ones."""
        if len(starts):
            turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            held = np.logical_and.reduce([T.is_in(k, chosen) for k in prefilter.keys(least[turn])])
            keep = np.repeat(held, np.diff(np.append(turn, len(least))))
            starts = starts[keep]
        return starts, T.run_hash(prefix, starts, starts + self.width)


@dataclass(frozen=True)
class Again:
    """An iterable that starts its generator anew for each reading."""

    make: Callable[[], Iterator]

    def __iter__(self) -> Iterator:
        return self.make()


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them came twice or more."""
    keys, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    return keys, counts > 1


def pack_keys(keys: np.ndarray, shift: int = 0) -> bytes:
    """Sorted keys, without their `shift` low bits, as the first and differences of as few bytes as the largest takes."""
    if not len(keys):
        return b""
    own = keys >> np.uint64(shift)
    gaps = np.diff(own)
    size = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([size, shift]) + own[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    size, shift = packed[0], packed[1]
    gaps = np.zeros(((len(packed) - 10) // size + 1, 8), np.uint8)
    gaps[1:, :size] = np.frombuffer(packed, np.uint8, offset=10).reshape(-1, size)
    gaps[0] = np.frombuffer(packed, np.uint8, 8, 2)
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(shift)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys start among the sorted keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))


def _sent(batch: int, keys: np.ndarray, twice: np.ndarray, shards: int, shift: int = 0) -> pa.Table:
    at = shard_bounds(keys, shards)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "shard": pa.array(full, pa.int32()),
            "batch": pa.array(np.full(len(full), batch), pa.int64()),
            "keys": pa.array([pack_keys(keys[at[s] : at[s + 1]], shift) for s in full], pa.binary()),
            "twice": pa.array([np.packbits(twice[at[s] : at[s + 1]]).tobytes() for s in full], pa.binary()),
        }
    )


def _chosen(back: pa.Table, round_: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The batch's sorted keys that the shards called repeated."""
    at, keep = shard_bounds(keys, shards), np.zeros(len(keys), bool)
    for r, s, bits in zip(*(back[c].to_pylist() for c in ("round", "shard", "bits")), strict=True):
        if r == round_:
            keep[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[s + 1] - at[s])
    return keys[keep]


def exact(keys: np.ndarray, weights: np.ndarray, least: int = 2) -> np.ndarray:
    """Mask of a shard's keys whose weights (1, or 2 for a batch's own repeats) add up to `least` or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    turn = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(weights[order].astype(np.int64), turn)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(total >= least, np.diff(np.append(turn, len(keys))))
    return out


@dataclass(frozen=True)
class Hashed:
    """The exact pass over windows by their own hash."""

    #: Batches from which on an anchor is told apart as frequent; None where the pass treats all alike.
    frequent: int | None = None

    def of(self, windows: Windows, data: np.ndarray, pieces: Iterable[tuple], prefilter: Plain, chosen: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the pass needs of a slice: here starts and hashes of its windows with a chosen anchor."""
        spots = [(low, *windows.candidates(prefix, starts, least, prefilter, chosen)) for low, prefix, _, starts, least in pieces]
        return np.concatenate([at + low for low, at, _ in spots]), np.concatenate([h for *_, h in spots])

    def send(self, batch: int, found: list[tuple], shards: int) -> pa.Table:
        """The batch's messages, as SENT."""
        return _sent(batch, *_distinct([h for _, h in found]), shards)

    def merge(self, rows: pa.Table, shards: int) -> list[np.ndarray]:
        """The bits that answer each message of a shard."""
        return merged_keys(rows)[0]

    def hits(self, found: list[tuple], back: pa.Table, shards: int) -> list[np.ndarray]:
        """Starts of the repeated windows of each slice."""
        keys = _chosen(back, 2, _distinct([h for _, h in found])[0], shards)
        return [at[T.is_in(h, keys)] for at, h in found]


def merged_keys(rows: pa.Table, frequent: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each message of a shard, which of its keys are repeated, and which stand in `frequent` messages or more."""
    parts = [unpack_keys(x) for x in rows["keys"].to_pylist()]
    sizes = [len(x) for x in parts]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["twice"].to_pylist(), sizes, strict=True)]
    keys, cuts = np.concatenate(parts), np.cumsum(sizes)[:-1]
    repeats = np.split(exact(keys, np.concatenate(twice) + 1), cuts)
    if frequent is None or len(parts) < frequent:
        return repeats, []
    return repeats, np.split(exact(keys, np.ones(len(keys)), frequent), cuts)


def answers(rows: pa.Table, round_: int, bits: list[np.ndarray]) -> pa.Table:
    """BACK rows of the messages that have a bit set."""
    some = np.array([x.any() for x in bits], bool)
    packed = pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())
    out = {"batch": rows["batch"], "round": pa.array(np.full(len(bits), round_), pa.int32()), "shard": rows["shard"], "bits": packed}
    return pa.table(out).filter(pa.array(some))


def repeated(docs: DataFrame, id_col: str, text_col: str, windows: Windows, prefilter: Callable[[int], Plain], finish: Callable[[bytes, np.ndarray], tuple], schema: str, second: Hashed = Hashed()) -> DataFrame:
    """finish(text, mask of its elements covered by repeated windows) for each document, as a row `doc_id, *schema`.

    prefilter makes the first round's filter for a corpus of so many bytes, second is the exact pass. Null texts are empty; rows with
    one id each keep their own row; a null id stays null.
    """
    total = text_bytes(docs, text_col)
    first = prefilter(total)
    batches = max(8, -(-total // min(max(BATCH_BYTES, total // BATCHES), MOST_BYTES)))
    anchor_shards = max(8, total // (16 << 20))
    shards = max(8, total // (4 << 20))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    width = windows.width

    def scans(texts: pa.Table) -> Iterable[Iterable[tuple]]:
        """The pieces of every slice: kept for a second reading in a batch of usual size, else made again."""
        whole = Again(lambda: (windows.scan(data, offsets) for _, _, data, offsets in T.slices(texts["text"])))
        return [list(pieces) for pieces in whole] if texts["text"].nbytes <= KEEP_BYTES else whole

    def anchors_of(scanned: Iterable[Iterable[tuple]]) -> tuple[np.ndarray, np.ndarray]:
        return _distinct([k for pieces in scanned for _, _, grams, starts, least in pieces for k in first.keys(windows.anchors(grams, starts, least))])

    def send_anchors(texts: pa.Table) -> pa.Table:
        return _sent(texts["batch"][0].as_py(), *anchors_of(scans(texts)), anchor_shards, first.shift)

    def found(texts: pa.Table, back: pa.Table) -> list[tuple]:
        scanned = scans(texts)
        keys = anchors_of(scanned)[0]
        chosen, often = _chosen(back, 1, keys, anchor_shards), _chosen(back, 3, keys, anchor_shards)
        datas = (data for _, _, data, _ in T.slices(texts["text"]))
        return [second.of(windows, data, pieces, first, chosen, often) for data, pieces in zip(datas, scanned, strict=True)]

    def send_windows(texts: pa.Table, back: pa.Table) -> pa.Table:
        if not texts.num_rows or not back.num_rows:
            return _sent(0, *_distinct([]), shards)
        return second.send(texts["batch"][0].as_py(), found(texts, back), shards)

    def merge_anchors(sent: pa.Table) -> pa.Table:
        repeats, often = merged_keys(sent, second.frequent)
        back = answers(sent, 1, repeats)
        return pa.concat_tables([back, answers(sent, 3, often)]) if often else back

    def merge_windows(sent: pa.Table) -> pa.Table:
        return answers(sent, 2, second.merge(sent, shards))

    def result(texts: pa.Table, back: pa.Table) -> pa.Table:
        hits = second.hits(found(texts, back), back, shards) if back.num_rows else []
        out: list[tuple] = []
        for k, (row, end, data, offsets) in enumerate(T.slices(texts["text"])):
            bounds = T.word_bounds(data, offsets)[2] if windows.words else offsets
            mask = T.covered(int(bounds[-1]), hits[k], width) if hits else np.zeros(int(bounds[-1]), bool)
            out += [finish(data[offsets[i] : offsets[i + 1]].tobytes(), mask[bounds[i] : bounds[i + 1]]) for i in range(end - row)]
        kinds = names(schema)
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.table({"doc_id": texts["doc_id"].cast(pa.int64())} | {n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), columns, strict=True)})

    anchored = rows.groupBy("batch").applyInArrow(send_anchors, SENT).groupBy("shard").applyInArrow(merge_anchors, BACK)
    sent = rows.groupBy("batch").cogroup(anchored.groupBy("batch")).applyInArrow(send_windows, SENT)
    windowed = sent.groupBy("shard").applyInArrow(merge_windows, BACK)
    return rows.groupBy("batch").cogroup(anchored.unionByName(windowed).groupBy("batch")).applyInArrow(result, f"doc_id long, {schema}")


def names(schema: str) -> dict[str, pa.DataType]:
    """Arrow types of a schema of longs, strings and binaries."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return {n: kinds[k] for n, k in (x.split() for x in schema.split(","))}
