"""Properties of the vector kernels against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldspark.llm import _repeats, near_dedup
from yieldspark.llm import _text as T
from yieldspark.llm.html_wrapper import Page, _align, pattern, stream

texts = st.lists(st.text(alphabet="ab \n\té\x0b<>/p1", max_size=40), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words(rows):
    for limit in (5, 1000):
        got = []
        for _, _, data, offsets in T.slices(pa.array(rows, pa.string()), limit):
            starts, ends, first = T.word_bounds(data, offsets)
            words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            got += [words[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == [r.encode().split() for r in rows]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9))
@settings(deadline=None)
def test_sliding(values, width):
    a = np.array(values, np.uint64)
    got = T.sliding(a, width, np.minimum).tolist()
    assert got == [min(values[k : k + width]) for k in range(len(values) - width + 1)]


@given(texts, st.integers(1, 6))
@settings(deadline=None)
def test_equal_runs_hash_equal(rows, width):
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    n = len(data) - width + 1
    if n > 0:
        at = np.arange(n)
        h = T.run_hash(T.prefix_hash(T.byte_values(data)), at, at + width).tolist()
        runs = [data[k : k + width].tobytes() for k in range(n)]
        assert len(set(h)) == len(set(runs)) and len({(x, y) for x, y in zip(h, runs, strict=True)}) == len(set(runs))


@given(st.lists(st.integers(0, 12), max_size=8), st.integers(1, 5))
@settings(deadline=None)
def test_window_starts_and_cover(sizes, width):
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    want = [k + width <= offsets[d + 1] for d, n in enumerate(sizes) for k in range(offsets[d], offsets[d] + n)]
    starts = T.window_starts(offsets, width)
    assert starts.tolist() == want
    at = np.flatnonzero(starts)
    assert T.covered(len(want), at, width).tolist() == [any(a <= k < a + width for a in at) for k in range(len(want))]


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.integers(2, 8), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_repeated_windows_have_repeated_anchors(letters, width, gram):
    """The cover property: two equal windows each hold an anchor, at positions of their own."""
    windows = _repeats.Windows(width, min(gram, width), words=False)
    data = np.frombuffer("".join(letters).encode(), np.uint8)
    ((_, _, grams, starts, least),) = windows.scan(data, np.array([0, len(data)]))
    anchors = windows.anchors(grams, starts, least).tolist()
    text = "".join(letters)
    for k, m in zip(starts, least.tolist(), strict=True):
        if sum(text[j : j + width] == text[k : k + width] for j in range(len(text) - width + 1)) > 1:
            assert anchors.count(m) > 1


@given(st.lists(st.sampled_from(["a", "bb", "é", "c d"]), min_size=1, max_size=60), st.integers(2, 7), st.integers(1, 20), st.booleans())
@settings(max_examples=200, deadline=None)
def test_pieces_find_the_same_windows(parts, width, piece, words):
    """A long text in pieces has each window once, with the same hash, and no anchor less."""
    windows = _repeats.Windows(width, min(3, width), words)
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    offsets = np.array([0, len(data)])

    def found(limit):
        before, _repeats.PIECE_ELEMENTS = _repeats.PIECE_ELEMENTS, limit
        try:
            pieces = list(windows.scan(data, offsets))
        finally:
            _repeats.PIECE_ELEMENTS = before
        at = [(low + s, int(h)) for low, prefix, _, starts, _ in pieces for s, h in zip(starts.tolist(), T.run_hash(prefix, starts, starts + width).tolist(), strict=True)]
        return sorted(at), {a for _, _, grams, starts, least in pieces for a in windows.anchors(grams, starts, least).tolist()}

    whole, anchors = found(1 << 20)
    cut, cut_anchors = found(piece)
    assert cut == whole and anchors == cut_anchors


def test_long_texts_hash_in_pieces():
    data = np.frombuffer(b" ".join(b"w%d" % k for k in range(500)) + b" " + b"y" * 300, np.uint8)
    starts, ends, _ = T.word_bounds(data, np.array([0, len(data)]))
    whole = T.word_hashes(data, starts, ends)
    before, T.PIECE_BYTES = T.PIECE_BYTES, 64
    try:
        assert (T.word_hashes(data, starts, ends) == whole).all()
    finally:
        T.PIECE_BYTES = before


@given(st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_pack(keys):
    a = np.array(sorted(keys), np.uint64)
    assert (_repeats.unpack_keys(_repeats.pack_keys(a)) == a).all()


@given(st.sets(st.integers(0, 2**52 - 1), min_size=30, max_size=300), st.integers(0, 20))
@settings(max_examples=30, deadline=None)
def test_registers_estimate(shingles, cut):
    a = np.array(sorted(shingles), np.uint64)
    b = a[cut:]
    both = np.concatenate([a, b])
    regs = near_dedup.hyper_registers(both, np.array([0, len(a), len(both)]))
    jaccard = len(b) / len(a)
    assert abs((regs[0] == regs[1]).mean() - jaccard) < 6 * np.sqrt(0.25 / min(len(b), near_dedup.BUCKETS))


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=x>", "</div>", "<ul>", "<li>", "</ul>", "word ", "&amp;", "<br>", "<!-- c", "-->", "<b", "<script>", "</script>", "<table><tr><td>"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_any_markup_parses_and_aligns(parts):
    one, two = stream(Page("".join(parts)).root), stream(Page("<p>other</p>" + "".join(parts[::2])).root)
    both = _align(one, two, 2)
    assert isinstance(pattern(both), str) and both[1] == 2
