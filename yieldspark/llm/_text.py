"""Byte-level text kernels: Arrow string columns in, NumPy arrays out.

Every kernel works on the flat UTF-8 buffer of many documents at once, so the cost per document
is a share of a few vector passes. A slice never splits a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Working memory is some 60 bytes a byte of a slice.
SLICE_BYTES = 1 << 18
#: Texts over this size are hashed in pieces: working memory is a multiple of a piece, not of a text.
PIECE_BYTES = 4 << 20
#: The white space of all word definitions: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as longer slices come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(18, int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large-binary array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a large-binary array."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole documents, about limit bytes at a time."""
    data, offsets = buffers(binary(column))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the first word of each document (one entry more than documents)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(elements: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, for run_hash."""
    out = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(elements * _power(_BASE, len(elements)), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hash of each run elements[start:end], the same wherever the run stands."""
    return mix((prefix[ends] - prefix[starts]) * _power(_UNBASE, len(prefix))[starts])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash a word; long texts go through in pieces of about PIECE_BYTES, cut between words."""
    if len(data) <= PIECE_BYTES:
        return run_hash(prefix_hash(_TABLE[data]), starts, ends)
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), PIECE_BYTES)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        base = starts[i]
        out[i:j] = run_hash(prefix_hash(_TABLE[data[base : ends[j - 1]]]), starts[i:j] - base, ends[i:j] - base)
    return out


def sliding(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` consecutive values."""
    n, span = len(a) - width + 1, 1
    if n <= 0:
        return a[:0]
    while span * 2 <= width:
        a, span = best(a[:-span], a[span:]), span * 2
    return best(a[:n], a[width - span : width - span + n])


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Mask over elements: a window of `width` elements of one document starts here."""
    n = int(offsets[-1])
    edge = np.zeros(n + 1, np.int32)
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    some = count > 0
    edge[offsets[:-1][some]] += 1
    edge[(offsets[:-1] + count)[some]] -= 1
    return np.cumsum(edge[:n]) > 0


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over n elements: inside some window that starts at one of starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true elements in each document."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
