"""Operator 4, benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Item texts are normalised to lower-case words between single spaces; all windows of all items form one
automaton, built once in each Python worker from the broadcast windows. A document is normalised by the
same table lookup and scanned once; only where something occurs are the hits mapped back to words and to
offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import row_of, staged, table

#: Bytes of item text in one automaton; a larger benchmark is scanned in several such parts. The automaton takes
#: about 440 bytes a byte of item text in each Python worker (measured), so a part is under 0.5 GB there.
PART_BYTES = 1 << 20
#: Delimiters: all ASCII but digits and letters. Each becomes a space, and A-Z lower case.
DELIMITER = np.ones(256, bool)
DELIMITER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
NORMAL = bytes(0x20 if DELIMITER[b] else int(T.LOWER[b]) for b in range(256))
HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_built: dict[bytes, ahocorasick.Automaton] = {}


def _normal(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(items: list[tuple[str, str]], width: int) -> dict[str, tuple[int, list[int]]]:
    """window (latin-1 view of its UTF-8, between spaces) -> (its words, places of its items)."""
    out: dict[str, tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = _normal((text or "").encode())
        for i in range(max(1, len(words) - width + 1) if words else 0):
            run = words[i : i + width]
            of = out.setdefault((b" " + b" ".join(run) + b" ").decode("latin-1"), (len(run), []))[1]
            if k not in of:
                of.append(k)
    return out


def _automaton(key: bytes, items: list[tuple[str, str]], width: int) -> ahocorasick.Automaton:
    """One for each Python worker."""
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for window, (n, of) in item_windows(items, width).items():
            made.add_word(window, (len(window), n, of))
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _offsets(text: bytes, mask: np.ndarray) -> list[dict[str, int]]:
    """Code-point spans, in the original text, of the runs of hit words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = T.word_bounds(data, np.array([0, len(data)]), DELIMITER)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"start": int(points[starts[i]]), "end": int(points[ends[j - 1]])} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, int, list[int], list[dict[str, int]]]:
    words = _normal(text)
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end, *what) for end, what in automaton.iter(normal)] if words and len(automaton) else []
    if not found:
        return len(words), 0, [], []
    mask, items = np.zeros(len(words), bool), set()
    spaces = np.cumsum(np.frombuffer(normal.encode("latin-1"), np.uint8) == 0x20)
    for end, size, n, of in found:
        first = spaces[end - size + 1] - 1
        mask[first : first + n] = True
        items.update(of)
    return len(words), int(mask.sum()), sorted(items), _offsets(text, mask)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, carry: bool = False) -> DataFrame:
    """Every word of a document inside an occurrence of a window of `window` consecutive item words.

    Returns doc_id, n_words, n_hit, items (ids as strings, sorted), spans (code points of the runs of hit
    words in the original text), a row for each input row. An item under `window` words is one window;
    items and texts without words match nothing; a null item id counts as the string "null". Equal items
    all count. A very long text is scanned whole. With carry, the input row comes along as a struct `row`.
    Other columns are ignored; an empty benchmark hits nothing; an empty table gives no rows.
    """
    row, kind = row_of(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([row] if carry else []))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES) or 1
    if parts > 1:
        return _in_parts(rows, items, parts, window)
    return _scanned(rows, [(r.item, r.text) for r in items.collect()], window, kind if carry else "")


def _scanned(rows: DataFrame, items: list[tuple[str, str]], window: int, carried: str = "") -> DataFrame:
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    sent = rows.sparkSession.sparkContext.broadcast(items)
    more = ["row"] if carried else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x for x, _ in sent.value]
        automaton = _automaton(key, sent.value, window)
        for batch in batches:
            out = [_scan(text, automaton) for text in T.binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in more),
                    batch.column("doc_id"),
                    *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)),
                    pa.array([sorted({names[i] for i in x[2]}) for x in out], pa.list_(pa.string())),
                    pa.array([x[3] for x in out], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                ],
                [*more, "doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return rows.mapInArrow(run, f"row {carried}, " * bool(carried) + HITS)


def _in_parts(rows: DataFrame, items: DataFrame, parts: int, window: int) -> DataFrame:
    """A benchmark over PART_BYTES: one scan for each part, hits united by row."""
    more = [c for c in rows.columns if c == "row"]
    tagged = staged(rows.select(F.monotonically_increasing_id().alias("place"), *rows.columns), "tagged")
    every = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        found = _scanned(tagged.select(F.col("place").alias("doc_id"), "text"), [(r.item, r.text) for r in part.collect()], window)
        every = found if every is None else every.unionByName(found)
    ends = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        ends,
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    united = every.groupBy(F.col("doc_id").alias("place")).agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged.alias("spans"))
    # words of the united spans
    texts = tagged.join(united, "place")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.regexp_count(F.expr("text").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    return texts.select(*more, "doc_id", "n_words", words.alias("n_hit"), "items", "spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
