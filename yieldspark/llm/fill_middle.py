"""Operator 12, fill-in-the-middle: a table-driven byte DFA finds units and sentinels in one scan.

A unit is a run of letters A-Z, a-z, or any other code point. The DFA reads UTF-8 bytes: a continuation
byte starts no unit, a letter starts one only outside a run, and `<P>`, `<S>`, `<M>` are recognised on the
way. Arcs (state, class) are looked up for whole arrays of bytes, as the state after a byte depends on the
classes of the last two bytes alone (`PAIR` is derived from the table and checked). The scan counts units,
sentinels and code points by arc; a second pass finds the bytes of the two cuts. Output is put together by
DataFrame functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import row_of, table

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: A longer text is scanned in pieces of so many bytes, so memory does not grow with it.
PIECE_BYTES = 1 << 20

# Byte classes; EDGE stands before a text's first byte.
OTHER, LETTER, P, S, M, OPEN, CLOSE, FOLLOW, EDGE = range(9)
# States: outside a run, in a run of letters, after `<`, and after `<` and each sentinel's letter.
OUT, RUN, OPENED, IN_P, IN_S, IN_M = range(6)

CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[[ord(c) for c in "PSM<>"]] = P, S, M, OPEN, CLOSE
CLASS[0x80:0xC0] = FOLLOW

STEP = np.full((6, 9), OUT, np.uint8)
STEP[:, [LETTER, P, S, M]] = RUN
STEP[OPENED, [P, S, M]] = IN_P, IN_S, IN_M
STEP[:, OPEN] = OPENED

#: By arc (state x class): does the byte start a unit, does it end a sentinel?
UNIT = np.ones((6, 9), bool)
UNIT[:, [FOLLOW, EDGE]] = False
UNIT[[[RUN], [IN_P], [IN_S], [IN_M]], [LETTER, P, S, M]] = False
MARK = np.zeros((6, 9), bool)
MARK[[IN_P, IN_S, IN_M], CLOSE] = True


def _pairs() -> np.ndarray:
    """The state after two classes, whatever the state before them."""
    after = STEP[STEP]  # state, class, class
    if (after != after[0]).any():
        raise ValueError("a state of the table depends on more than two bytes")
    return after[0]


PAIR = _pairs()


def arcs(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The arc (state x 9 + class) taken at each byte; `first` are the places of the texts' first bytes."""
    kind = np.full(len(data) + 2, EDGE, np.uint8)
    kind[2:] = CLASS[data]
    one, two = kind[1:-1].copy(), kind[:-2].copy()  # the byte before, and the one before that
    one[first] = EDGE
    two[first] = EDGE
    two[first[first + 1 < len(data)] + 1] = EDGE
    return PAIR[two, one] * np.uint8(9) + kind[2:]


def _pieces(text: np.ndarray):
    """(first byte, arcs) of each piece: two bytes of the one before give the state."""
    for low in range(0, len(text), PIECE_BYTES):
        lead = min(low, 2)
        yield low, arcs(text[low - lead : low + PIECE_BYTES], np.zeros(1, np.int64))[lead:]


_START, _END_MARK = UNIT.ravel(), MARK.ravel()
_POINT = np.tile(np.arange(9) != FOLLOW, 6)  # all but continuation bytes start a code point


def cuts(column: pa.Array, draws: list[np.ndarray]) -> list[np.ndarray]:
    """For each text: units, sentinels, code points, and code points before the first and the second cut.

    A cut is a draw modulo (units + 1): so many units lie before it.
    """
    out = [np.zeros(len(column), np.int64) for _ in range(5)]
    for row, end, data, offsets in T.slices(column):
        rows = slice(row, end)
        if end == row + 1 and len(data) > PIECE_BYTES:
            counted = np.array([[t[a].sum() for t in (_START, _END_MARK, _POINT)] for _, a in _pieces(data)])
            upto = np.concatenate([np.zeros((1, 3), np.int64), counted.cumsum(0)])
            n, marks, points = upto[-1]
            at = sorted(int(d[row] % (n + 1)) for d in draws)
            places = [points, points]
            for k, (_, a) in enumerate(_pieces(data)):
                for c, u in enumerate(at):
                    if upto[k, 0] <= u < upto[k + 1, 0]:
                        place = np.flatnonzero(_START[a])[u - upto[k, 0]]
                        places[c] = upto[k, 2] + _POINT[a[:place]].sum()
            for o, v in zip(out, (n, marks, points, *places), strict=True):
                o[row] = v
            continue
        arc = arcs(data, offsets[:-1][np.diff(offsets) > 0])
        starts = np.flatnonzero(_START[arc])
        units = np.searchsorted(starts, offsets)
        marks = np.searchsorted(np.flatnonzero(_END_MARK[arc]), offsets)
        points = np.concatenate([[0], np.cumsum(_POINT[arc])])
        n = np.diff(units)
        pair = np.sort([d[rows] % (n + 1) for d in draws], axis=0)
        starts = np.append(starts, len(data))
        places = [points[np.where(u < n, starts[np.minimum(units[:-1] + u, len(starts) - 1)], offsets[1:])] - points[offsets[:-1]] for u in pair]
        for o, v in zip(out, (n, np.diff(marks), np.diff(points[offsets]), *places), strict=True):
            o[rows] = v
    return out


_CUTS = "struct<units:bigint,marks:bigint,points:bigint,first:bigint,second:bigint>"


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    found = cuts(text, [one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)])
    return pa.StructArray.from_arrays([pa.array(f) for f in found], ["units", "marks", "points", "first", "second"])


def _draw(key: Column, k: int) -> Column:
    return F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20, carry: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, text, output: a row for each input row.

    Draws are the first four 8-digit groups of sha256(seed:doc_id), of an empty id where it is null: two cuts
    in units, then `percent` of texts are rearranged, `spm_percent` of those as suffix, prefix, middle. Null
    texts count as empty; empty texts and texts that hold a sentinel stay plain. Repeated rows give repeated
    rows (rows that share an id share its draws); very long texts are scanned whole, in pieces; bytes that are
    no UTF-8 belong to the unit before; an empty table gives none. With carry, the input row comes along as
    a struct `row`; without, other columns are ignored, whatever their names.
    """
    row, _ = row_of(docs)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("key"), *([row] if carry else []))
    more = ["row"] if carry else []
    rows = rows.select(*more, "doc_id", "text", "key", F.arrow_udf(_cuts, _CUTS)(F.col("text").cast("binary"), _draw(F.col("key"), 0), _draw(F.col("key"), 1)).alias("cut"))
    plain = (F.col("cut.points") == 0) | (F.col("cut.marks") > 0) | (_draw(F.col("key"), 2) % 100 >= percent)
    form = F.when(plain, "plain").when(_draw(F.col("key"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select(*more, "doc_id", "text", F.col("cut.units").alias("n"), form.alias("form"), F.col("cut.first").cast("int").alias("a"), F.col("cut.second").cast("int").alias("b"), F.col("cut.points").cast("int").alias("end"))
    prefix, middle, suffix = (F.substring("text", x, n) for x, n in ((F.lit(1), F.col("a")), (F.col("a") + 1, F.col("b") - F.col("a")), (F.col("b") + 1, F.col("end") - F.col("b"))))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved = F.col("form") != "plain"
    chars = [F.when(moved, c.cast("long")).alias(n) for n, c in (("prefix_chars", F.col("a")), ("middle_chars", F.col("b") - F.col("a")))]
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(*more, "doc_id", "n", "form", *chars, "text", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from: its parts stand between the first sentinels, in the form's order."""
    opening, second = F.lit(len(PREFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    one = F.when(form == "psm", F.locate(SUFFIX, output, len(PREFIX) + 1)).otherwise(F.locate(PREFIX, output, len(SUFFIX) + 1))
    rest = F.substring(output, one + F.length(second), F.length(output))
    two = F.locate(MIDDLE, rest)
    left, right = F.substring(output, opening + 1, one - opening - 1), F.substring(rest, F.lit(1), two - 1)
    middle = F.substring(rest, two + len(MIDDLE), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
            sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
    h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2,
            ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m)::BIGINT END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p"""
