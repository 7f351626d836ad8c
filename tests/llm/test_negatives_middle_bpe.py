"""Operators 11 to 13 against brute force, the tokenizers library and exact round trips."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from yieldspark.llm import bpe, fill_middle, hard_negatives

EXTRA = ["row", "key", "cut", "list", "block", "wave", "place", "ids", "output", "distance", "vector", "form", "n", "first"]
VECTORS = "vec_id long, embedding array<float>, label int"


# --- 11


def brute_negatives(rows, positives=5, negatives=10):
    """Rows as (vec_id, v, label); each row stands for itself."""
    rows = [(i, [math.floor(256 * c) for c in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if None not in (i, v, l) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, v, l) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, b, m) for b, (j, w, m) in enumerate(rows) if b != a)
        for s, j, _, _ in [x for x in scored if x[3] == l][:positives]:
            fit = [(-t, k) for t, k, _, m in scored if m != l and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def negatives(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in EXTRA})
    q = hard_negatives.quantised(df)
    q = q.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(map(tuple, hard_negatives.hard_negatives(q, **more).collect()))


def random_rows(seed, n, dim=6, near=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dim))
    return [(int(i), (middles[rng.integers(5)] + near * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(4))) for i in rng.permutation(n) * 5]


def test_negatives_equal_brute_force_over_many_lists(spark, monkeypatch):
    for name, value in {"LISTS": 12, "FIRST": 2, "BLOCK": 40, "WAVE": 2, "CELLS": 50}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = random_rows(3, 240)
    assert negatives(spark, rows) == brute_negatives(rows) != []


def test_negatives_with_a_hot_vector_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = random.Random(4)
    hot = [0.5, 0.25, -0.125]
    rows = [(100 * k if k % 3 else 10 * k + 1, hot, k % 3) for k in range(60)]
    rows += [(7 * k + 1, [rng.choice([0.25, 0.5]), rng.random(), 0.125], k % 4) for k in range(60)]
    rows += rows[5:9]  # repeated rows, anchors among them
    assert negatives(spark, rows) == brute_negatives(rows) != []


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 2), (2, [0.5, 0.0], 2), (3, [0.75, 0.0], 1), (None, [1.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0, 0.0], None), (9, [0.5], 2), (10, [], 2), (200, [-1.0, 0.0], 9), (300, [0.0, 0.0], 5), (301, [0.0, 0.0], 5), (400, [1.0, 1.0], 77)]
    assert negatives(spark, rows) == brute_negatives(rows) != []
    assert negatives(spark, []) == []
    assert negatives(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) == [(100, 1, 1, 2, 0, 0)]


def test_negatives_of_long_vectors_are_exact(spark):
    """Products beyond float64: 2**40 + 1 and 2**40 differ by less than it holds."""
    rows = [(100, [2.0**20, 1.0], 1), (1, [2.0**20, 1.0], 1), (2, [0.5 * 2.0**20, 1.0], 2), (3, [0.5 * 2.0**20, 0.5], 2), (4, [0.5 * 2.0**20, 0.75], 3)]
    got = negatives(spark, rows)
    assert [r[3] for r in got] == [2, 4, 3] and got == brute_negatives(rows)


def test_lists_outside_the_window_are_passed_over(spark):
    rows = [(k, [1.0 if k % 2 else -1.0, k / 1000], k % 4) for k in range(1, 200)] + [(200, [1.0, 0.0], 1)]
    index = hard_negatives.Index(hard_negatives.quantised(spark.createDataFrame(rows, VECTORS)))
    asked = index.rows.where("vec_id = 200").select("row", "label", "vector", F.array(F.lit(60_000).cast("long")).alias("floors"), F.array(F.lit(70_000).cast("long")).alias("tops"))
    seen = {r["list"] for first in (True, False) for r in hard_negatives._visits(index, asked.withColumn("wave", F.lit(0)), first).collect()}
    held = {r["list"]: r["v"] for r in index.rows.groupBy("list").agg(F.sum((F.col("vec_id") % 2 == 1).cast("int")).alias("v")).collect()}
    assert {k for k, odd in held.items() if odd} <= seen and len(seen) < len(held)


def test_waves_hold_neighbours(spark, monkeypatch):
    """About WAVE anchors a wave, whatever list holds them; anchors of a list share few waves."""
    monkeypatch.setattr(hard_negatives, "WAVE", 10)
    rows = [(k, 0 if k < 70 else 1 + k % 3) for k in range(100)]
    got = hard_negatives._waved(spark.createDataFrame(rows, "row long, list int")).collect()
    waves = {}
    for r in got:
        waves.setdefault(r["wave"], []).append(r["list"])
    assert set(waves) <= set(range(10)) and all(set(v) == {0} for w, v in waves.items() if w < 7) and len({r["wave"] for r in got if r["list"] == 1}) <= 2
    assert hard_negatives._waved(spark.createDataFrame([], "row long, list int")).count() == 0


def test_best_keeps_the_first_of_ties():
    scores = np.array([[3.0, 5, 5, 5, 1], [1, 1, 1, 1, 1]])
    fits = np.array([[True] * 5, [False, True, True, True, False]])
    at, row = hard_negatives._best(scores, fits, 2)
    assert list(zip(at.tolist(), row.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]


# --- 12


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


TEXTS = st.text(st.sampled_from("abPSM<>é日😀 \n1"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6), st.integers(0, 1 << 32), st.integers(0, 1 << 32), st.sampled_from([1, 3, 1 << 20]))
def test_cuts_of_slices_and_pieces(texts, one, two, piece):
    draws = [np.full(len(texts), d) for d in (one, two)]
    held, fill_middle.PIECE_BYTES = fill_middle.PIECE_BYTES, piece
    try:
        alone = [[int(x[0]) for x in fill_middle.cuts(pa.array([t]), [d[:1] for d in draws])] for t in texts]
        together = list(zip(*(x.tolist() for x in fill_middle.cuts(pa.array(texts), draws)), strict=True))
    finally:
        fill_middle.PIECE_BYTES = held
    for t, got, same in zip(texts, alone, together, strict=True):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        cut = sorted(d % (len(units) + 1) for d in (one, two))
        assert got == list(same) == [len(units), sum(t.count(x) for x in fill_middle.SENTINELS), len(t), *(len("".join(units[:u])) for u in cut)]


def test_the_table_tells_states_by_two_bytes():
    for x in range(9):
        for y in range(9):
            assert len({int(fill_middle.STEP[fill_middle.STEP[s, x], y]) for s in range(6)}) == 1


def test_fill_in_middle_rows(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 1000)
    rng = random.Random(6)
    pool = ["alpha", "Été", " ", " ", "\n", "<", ">", "P", "<P", "S>", "<M>" * 3, "日本", "😀", "12", ".", "<S"]
    rows = [(k, "".join(rng.choice(pool if k % 3 else pool[:5]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(None, "no id, some text"), (None, None), (301, None), (302, ""), (303, "\x00\t\r\n"), (304, "word " * 3000), (305, "é" * 2000), (306, "a" * 400_000), (307, "<" * 500 + "P" + ">" * 5), rows[3], rows[3], (10**15, "<P"), (-4, "x<S")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    tidy = lambda xs: sorted(xs, key=repr)
    assert tidy((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out) == tidy(brute_middle(*r) for r in rows)
    assert all(r["back"] == r["text"] for r in out) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    kept = fill_middle.fill_in_middle(df, carry=True).select("row.*")
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0


# --- 13

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


PARTS = ["a", "b", "e", "t", "h", "in", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "<|endoftext|>", "<|endof", "'s", "'", "S", "1", "12", "!", "!!", "=", " ", "　", "\x1c", "\x85", "xxxxx", "---------", "aaaa", "eeee", "ﬁ", "٣", "क्", "﻿", "\x00"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30))
def test_bpe_equals_the_library(library, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    automaton = bpe.load(PATH)
    ids = automaton.encode(pa.array([text]))
    assert ids.to_pylist() == [library.encode(text, add_special_tokens=False).ids]
    assert automaton.decode(ids).to_pylist() == [text] == [library.decode(ids.to_pylist()[0], skip_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_400), max_size=12), min_size=1, max_size=4))
def test_any_ids_decode_as_in_the_library(library, lists):
    assert bpe.load(PATH).decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(ids, skip_special_tokens=False) for ids in lists]


def bpe_by_merging(word, merges):
    """The textbook loop: merge the leftmost pair of the least rank until none is left."""
    parts = [bytes([b]) for b in word]
    rank = {pair: k for k, pair in enumerate(merges)}
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: (rank.get((parts[k], parts[k + 1]), 1 << 30), k))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_gadgets_of_random_merges(data):
    """Automata over few letters, where merges overlap, repeat and never apply."""
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 12))):
        pair = tuple(data.draw(st.sampled_from(tokens)) for _ in range(2))
        if b"".join(pair) not in tokens:
            tokens.append(b"".join(pair))
            merges.append(pair)
    labels = dict(enumerate([bytes([b]) for b in range(256)] + tokens[3:]))
    ids = {v: k for k, v in labels.items()}
    automaton = bpe.Automaton(labels, [(ids[a], ids[b], ids[a + b]) for a, b in merges], {})
    for _ in range(20):
        word = data.draw(st.text("abc", max_size=14)).encode()
        assert [labels[t] for t in automaton.path(word)] == bpe_by_merging(word, merges)


def test_every_code_point_has_the_librarys_class(library):
    """Each code point beside letters, blanks, numbers and marks; many texts in one call."""
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1{chr(c)}  {chr(c)}.'{chr(c)}" for c in range(low, low + 256) if not 0xD800 <= c < 0xE000) for low in range(0, 0x110000, 256)]
    assert bpe.load(PATH).encode(pa.array(texts)).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("slots", [4, 1 << 12])
def test_pieces_and_slots(library, monkeypatch, slots):
    """Small pieces, and a table in which words drive each other out."""
    for name, value in {"PIECE_BYTES": 20, "SLOTS": slots, "ARCS": 5, "WIDE": 3}.items():
        monkeypatch.setattr(bpe, name, value)
    rng, automaton = random.Random(2), bpe.Automaton.__new__(bpe.Automaton)
    automaton.__setstate__(bpe.load(PATH).__getstate__())
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(7)]
        assert all("".join(bpe._pieces(t)) == t for t in texts if t)
        got = automaton.encode(pa.array(texts, pa.string()))
        assert got.to_pylist() == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert automaton.decode(got).to_pylist() == [t or "" for t in texts]


def test_bytes_that_are_no_text(library):
    raw = [b"ab \xff\xfe cd", b"\x80", "é".encode()[:1] + b" x"]
    got = bpe.load(PATH).encode(pa.array(raw, pa.binary())).to_pylist()
    assert got == [library.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids for r in raw]


def test_bpe_rows(spark, library):
    texts = [None, "", "one text of words", "<|endoftext|>", "a" * 100_000, "word " * 20_000, "é日😀 " * 50, "\n\n  \t x"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(2, texts[2])] * 3 + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    coded = bpe.encode(df, PATH)
    out = coded.withColumn("back", bpe.decoded(spark, F.col("ids"), PATH)).collect()
    tidy = lambda xs: sorted(xs, key=repr)
    assert tidy((r["doc_id"], r["ids"], r["back"]) for r in out) == tidy((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert bpe.encode(df, PATH, carry=True).select("row.*").columns == df.columns
    assert bpe.encode(df.where("false"), PATH).count() == 0
    assert spark.range(1).select(bpe.decoded(spark, F.lit(None).cast("array<int>"), PATH)).first()[0] == ""


def test_bpe_query_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(map(tuple, bpe.op13_bpe(spark, "/root/testdata/sf0.001").collect()))
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs}
    assert got == sorted((i, len(x), brute.sha(",".join(map(str, x))), brute.sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items())
