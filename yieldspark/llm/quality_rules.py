"""Operator 8, quality rules: a bitmask ledger.

Every rule is evaluated once: measurements come from one pass over the texts, and bit k of `failed` says
that rule k of RULES fails. Policies are versioned masks over those bits, so a policy, a new version or an
ablation never reads the texts again: kept = (failed & mask) = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._spark import table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_bullet_lines", "n_cut_lines", "most_line_bytes")
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Starts of list items and ends of cut lines.
BULLETS, CUT = tuple(x.encode() for x in ("- ", "* ", "\u2022")), tuple(x.encode() for x in ("...", "\u2026"))
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: name -> condition of failure over the measurements; a rule's bit is its place here. Only append.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "few_letter_words": "100 * n_letter_words < 80 * n_words",
    "many_bullets": "100 * n_bullet_lines > 90 * n_lines",
    "many_cut_lines": "100 * n_cut_lines > 30 * n_lines",
    "one_long_line": "most_line_bytes > 100000",
}
#: Versioned policies: the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "many_symbols", "short_words", "long_words", "duplicate_lines"),
    "v3": ("few_words", "repeated_words", "many_symbols", "short_words", "long_words", "duplicate_lines", "few_letter_words", "many_bullets", "many_cut_lines", "one_long_line"),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def passes(policy: str | tuple[str, ...], failed: str = "failed") -> Column:
    """Whether the ledger's bits pass a policy (its version, or rule names)."""
    return F.col(failed).bitwiseAND(mask(POLICIES[policy] if isinstance(policy, str) else policy)) == 0


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = T.word_bounds(data, offsets)
    hashes = T.word_hashes(data, starts, ends) | np.uint64(1)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~T.SPACE[data] & ((data & 0xC0) != 0x80), out=chars[1:])
    prefix = T.prefix_hash(hashes)
    at = np.flatnonzero(T.window_starts(first, 3))
    docs = np.searchsorted(first, at, "right") - 1
    keys = T.run_hash(prefix, at, at + 3) ^ T.mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    ordered = keys[order]
    twice = np.zeros(len(keys), bool)
    same = ordered[1:] == ordered[:-1]
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    lettered = letters[ends] > letters[starts]
    lines, repeats, bullets, cut, most = [], [], [], [], []
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        full = [x for x in data[i:j].tobytes().split(b"\n") if x.strip()]
        lines.append(len(full))
        repeats.append(len(full) - len(set(full)))
        bullets.append(sum(x.startswith(BULLETS) for x in full))
        cut.append(sum(x.endswith(CUT) for x in full))
        most.append(max(map(len, full), default=0))
    return {
        "n_words": np.diff(first),
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_lines": np.array(lines),
        "n_dup_lines": np.array(repeats),
        "n_repeat_words": T.per_document(T.covered(len(starts), at[twice], 3), first),
        "n_letter_words": T.per_document(lettered, first),
        "n_bullet_lines": np.array(bullets),
        "n_cut_lines": np.array(cut),
        "most_line_bytes": np.array(most),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed` (long, a bit for each of RULES), a row for each input row.

    n_lines and n_dup_lines count \\n-split lines with a word. Null, empty and blank texts measure 0 and fail
    few_words only. Repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in T.slices(batch.column("text")):
                measured = _measure(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *(pa.array(measured[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, LEDGER)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed)


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: documents failing it, dropped by it alone, and kept if it were left out."""
    whole = mask(POLICIES[policy])
    masks = rows.groupBy(F.col("failed").bitwiseAND(whole).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy])))
    cells = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return cells.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(F.col("bits") == F.col("bit"))("n_only"),
        total(F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0)("n_kept_without"),
        F.bit_or(F.col("bits")).alias("bits_seen"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("v1")).alias("base_failed"), (passes("v1") & passes("v2")).alias("kept"), F.col("failed").bitwiseAND(mask(POLICIES["v2"])).alias("failed"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the last policy does, of all documents: from the ledger's bits alone."""
    return ablations(ledger(table(spark, sf_dir, "documents")), "v3").select("rule", "n_failed", "n_only", "n_kept_without")
