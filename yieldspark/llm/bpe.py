"""Operator 13, BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts just the sequences that BPE gives. It begins as one state in which
every byte is an arc back to it. Merges are compiled in order, each by a gadget: where an arc a leads to a
state that has an arc b, a leads from now on to a copy of that state without b, and an arc for the merged
token leads past both. All arcs of one token lead to one state, so the state after a token is the chain of
the gadgets along its right parts, each as of the time the token was made; `follows` walks such a chain.
Arcs are kept in a table as they are first taken. Each prefix of a word has one accepted path, so a word is
encoded left to right along a byte trie of the tokens, longest arc first, and no place is entered twice; a
path's arc labels joined are the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm._spark import row_of, table

#: Slots of the table of words met before, tokens a slot holds, and bytes of its longest word.
SLOTS, WIDE, LONGEST = 1 << 20, 8, 15
#: Arcs that a task keeps at once; beyond it their table starts anew.
ARCS = 500_000
#: Bytes encoded at once; a longer text goes through in pieces cut between a word and white space.
PIECE_BYTES = 1 << 20
#: Vocabulary files up to this size go to the driver and, compiled, to the executors.
VOCABULARY_BYTES = 64 << 20

# Classes of code points: words are runs of letters, of numbers or of other marks, each with one blank before it.
SPACE, LETTER, NUMBER, OTHER = range(4)
# Word ends that are split off after an apostrophe.
ONE, TWO = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")
_SEAM = re.compile(r"\S(?=[ \n])")
_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(16)], np.uint64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind  # no run spans the surrogates
    return out


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask over code points: a word starts here. first: the places of the texts' first code points.

    A run of one class is a word. Of white space before another run the last one stands apart, and belongs to
    that run if it is a blank. An apostrophe that starts a word takes one of the fixed ends with it.
    """
    kind = _classes()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[first] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:-1]) + 1
    blank = codes[after - 1] == 0x20
    start[after[blank]] = False
    start[after - 1] = True
    marks = np.flatnonzero((codes == 0x27) & start)
    if marks.size:
        padded, cut = np.append(codes, [0, 0]), np.append(edge, [True, True])
        one = np.where(cut[marks + 1], 0, padded[marks + 1])
        two = np.where(cut[marks + 1] | cut[marks + 2], 0, padded[marks + 2])
        short = np.isin(one, [e[0] for e in ONE])
        long = ~short & np.logical_or.reduce([(one == a) & (two == b) for a, b in TWO])
        start[marks[short | long] + 1] = False
        ends = np.concatenate([marks[short] + 2, marks[long] + 3])
        start[ends[ends < len(codes)]] = True
    return start


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """labels: a token's bytes by id; merges: (left, right, merged) ids in order; special: texts that are one token."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]) -> None:
        self.labels, self.special = labels, special
        merged = {c for *_, c in merges}
        self.byte = {labels[t][0]: t for t in labels if len(labels[t]) == 1 and t not in merged and t not in special.values()}
        if len(self.byte) < 256:
            raise ValueError("a byte is no token of the vocabulary")
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, time
        self.gadget: dict[tuple[int, int], int] = {}  # (token, arc taken from the state after it): time
        live = set(self.byte.values())
        for time, (a, b, c) in enumerate(merges):
            if a in live and b in live and c not in live and self.follows(a, b):
                self.gadget[a, b] = time
                self.made[c] = (a, b, time)
                live.add(c)
        self.trie: dict = {}  # byte -> node; at -1 the token that ends there
        for t in sorted(live):
            node = self.trie
            for x in labels[t]:
                node = node.setdefault(x, {})
            node[-1] = t
        self.size = {t: len(labels[t]) for t in live}
        self.span = max(self.size.values())
        self.shorter = {t: self._longest(labels[t], 0, len(labels[t]) - 1) for t in live}  # the longest token that begins a token
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._fresh()

    def _fresh(self) -> None:
        self.arcs: dict[int, dict[int, bool]] = {}
        self.kept = 0
        self.low, self.high, self.count, self.tokens = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8), np.zeros((SLOTS, WIDE), np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "kept", "low", "high", "count", "tokens")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def follows(self, a: int, t: int) -> bool:
        """Has the state after token a an arc t? Not if a gadget on its chain took away t, or a left part of t
        before t was made of it."""
        none = len(self.gadget) + len(self.labels)
        x, until = a, none
        while True:
            u, by = t, none
            while True:
                time = self.gadget.get((x, u))
                if time is not None and time < until and time <= by:
                    return False
                if u not in self.made:
                    break
                u, _, by = self.made[u]
            if x not in self.made:
                return True
            _, x, until = self.made[x]

    def _longest(self, word: bytes, low: int, high: int) -> int:
        """The longest token that begins at low and ends by high; -1 if there is none."""
        node, found = self.trie, -1
        for x in word[low:high]:
            node = node.get(x)
            if node is None:
                break
            found = node.get(-1, found)
        return found

    def path(self, word: bytes) -> list[int]:
        """The accepted path of a word: from each place the longest arc first, shorter ones after.

        A place is reached by one path only, so one from which no arc leads on is left for good.
        """
        if self.kept >= ARCS:
            self.arcs, self.kept = {}, 0
        span, n, size, shorter, trie, arcs = self.span, len(word), self.size, self.shorter, self.trie, self.arcs
        out: list[int] = []
        dead: set[int] = set()
        place, row, t = 0, None, None
        while place < n:
            if t is None:
                node, t = trie, -1
                for x in word[place : place + span] if place else word:
                    node = node.get(x)
                    if node is None:
                        break
                    if -1 in node:
                        t = node[-1]
            while t >= 0:
                if row is None:
                    has = True
                else:
                    has = row.get(t)
                    if has is None:
                        has = row[t] = self.follows(out[-1], t)
                        self.kept += 1
                if has and not (dead and place + size[t] in dead):
                    break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                place += size[t]
                row = arcs.get(t)
                if row is None:
                    row = arcs[t] = {}
                t = None
            else:
                dead.add(place)
                last = out.pop()
                place -= size[last]
                row, t = arcs[out[-1]] if out else None, shorter[last]
        return out

    def _paths(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        paths = [self.path(w) for w in words]
        return paths, np.fromiter(map(len, paths), np.int64, len(paths))

    def _flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and the first id of each text (one entry more).

        Words of up to LONGEST bytes are looked up by their bytes and length in a table of the words met before.
        """
        codes = np.frombuffer((raw := data.tobytes()).decode().encode("utf-32-le"), np.uint32)
        points = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(points, offsets)
        starts = points[word_starts(codes, at[:-1][np.diff(at) > 0])]
        size = np.diff(np.append(starts, len(data)))
        padded = np.append(data, np.zeros(16, np.uint8))
        pair = np.lib.stride_tricks.sliding_window_view(padded, 16)[starts].view("<u8") & _MASKS[np.minimum(size, LONGEST)]
        low, high = pair[:, 0], pair[:, 1] | (size.astype(np.uint64) << np.uint64(56))
        slot = ((low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % SLOTS
        brief = size <= LONGEST
        known = lambda: brief & (self.low[slot] == low) & (self.high[slot] == high)
        words = lambda at: [raw[i:j] for i, j in zip(starts[at].tolist(), (starts[at] + size[at]).tolist(), strict=True)]
        new = np.flatnonzero(~known() & brief)
        new = new[np.unique(slot[new], return_index=True)[1]]  # one word a slot
        paths, n = self._paths(words(new))
        fit = np.flatnonzero(n <= WIDE)
        s, n = slot[new[fit]], n[fit]
        self.low[s], self.high[s], self.count[s] = low[new[fit]], high[new[fit]], n
        rows = self.tokens[s]
        rows[np.arange(WIDE) < n[:, None]] = np.fromiter(chain.from_iterable([paths[i] for i in fit.tolist()]), np.int32)
        self.tokens[s] = rows
        hit = known()  # new words have driven others out
        rest = np.flatnonzero(~hit)
        several = words(rest)
        found = dict(zip(once := list(dict.fromkeys(several)), self._paths(once)[0], strict=True))
        paths = [found[w] for w in several]
        n = np.where(hit, self.count[slot], 0).astype(np.int64)
        n[rest] = [len(p) for p in paths]
        ends = np.concatenate([[0], n.cumsum()])
        out = np.empty(ends[-1], np.int32)
        seen = np.flatnonzero(hit)
        held = n[seen]
        out[np.repeat(ends[seen] - (held.cumsum() - held), held) + np.arange(held.sum())] = self.tokens[slot[seen]][np.arange(WIDE) < held[:, None]]
        if paths:
            out[np.repeat(ends[rest] - (n[rest].cumsum() - n[rest]), n[rest]) + np.arange(n[rest].sum())] = np.fromiter(chain.from_iterable(paths), np.int32)
        return out, ends[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> pa.Array:
        """Ids of each text; null counts as empty, bytes that are no UTF-8 as the mark U+FFFD."""
        runs: list[bytes] = []  # pieces between special tokens
        row_of: list[int] = []
        special: list[int] = []  # the special token after each piece, or -1
        for row, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            whole = (text or b"").decode("utf-8", "replace")
            for k, part in enumerate(self.split.split(whole) if self.split else [whole]):
                if k % 2:
                    special[-1] = self.special[part]
                    continue
                for piece in _pieces(part):
                    runs.append(piece.encode())
                    row_of.append(row)
                    special.append(-1)
        found, sizes = [], np.zeros(len(texts), np.int64)
        k = 0
        while k < len(runs):
            end, held = k, 0
            while end < len(runs) and (end == k or held + len(runs[end]) <= PIECE_BYTES):
                held += len(runs[end])
                end += 1
            flat, first = self._flat(np.frombuffer(b"".join(runs[k:end]), np.uint8), np.cumsum([0, *map(len, runs[k:end])]))
            more = np.array(special[k:end])
            if (more >= 0).any():
                flat = np.insert(flat, first[1:][more >= 0], more[more >= 0])
            np.add.at(sizes, row_of[k:end], np.diff(first) + (more >= 0))
            found.append(flat)
            k = end
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.Array | pa.ChunkedArray) -> pa.Array:
        """Arc labels joined, a text for each list of ids; ids that are no token give nothing, bytes that are no
        UTF-8 the mark U+FFFD."""
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).cumsum()])
        labels = pa.array([self.labels.get(i, b"") for i in range(max(self.labels) + 1)] + [b""], pa.large_binary())
        joined = labels.take(pa.array(np.where((flat < 0) | (flat >= len(labels)), len(labels) - 1, flat)))
        _, offsets, data = joined.buffers()
        starts = np.frombuffer(offsets, np.int64)[: len(joined) + 1][ends]
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(starts)), data])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())  # CPython replaces as the library does

def _pieces(text: str) -> Iterator[str]:
    """Cut where a blank or line end follows a mark: no word spans that. One unbroken word is one piece."""
    low = 0
    while len(text) - low > PIECE_BYTES:
        seam = _SEAM.search(text, low + PIECE_BYTES)
        if seam is None:
            break
        yield text[low : seam.end()]
        low = seam.end()
    yield text[low:] if low else text


@lru_cache(maxsize=4)
def _compiled(content: str) -> Automaton:
    spec = json.loads(content)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in special}
    labels |= {i: token.encode() for token, i in special.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE file of the tokenizers library (words split by class, merges in order)."""
    with open(path, encoding="utf-8") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {VOCABULARY_BYTES} characters")
    return _compiled(content)


def _coders(spark: SparkSession, path: str):
    sent = spark.sparkContext.broadcast(load(path))

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return sent.value.encode(texts)

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        return sent.value.decode(ids)

    return encoded, decoded


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, ids (array of int): a row for each input row.

    Null texts count as empty and give no ids. Special tokens in a text are one id each. Repeated rows give
    repeated rows; very long texts are encoded whole, in pieces that end with a word (time and memory grow in
    proportion, for one unbroken word as well); bytes that are no UTF-8 count as U+FFFD; an empty table gives none. With carry, the input row comes
    along as a struct `row`; without, other columns are ignored, whatever their names.
    """
    row, _ = row_of(docs)
    encoded, _ = _coders(docs.sparkSession, vocabulary)
    rows = docs.select(*([row] if carry else []), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(*(["row"] if carry else []), "doc_id", encoded("text").alias("ids"))


def decoded(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The text of an array of ids, special tokens written out; null ids give an empty text."""
    return _coders(spark, vocabulary)[1](ids)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents"), path)
    both = coded.select("doc_id", "ids", decoded(spark, F.col("ids"), path).alias("back"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("back")).alias("decoded_sha256"))
