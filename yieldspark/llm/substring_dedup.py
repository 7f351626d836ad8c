"""Operator 9, substring dedup: repeated word windows behind a count-min prefilter.

Each batch of documents counts its windows' anchors (see _repeats) in a count-min sketch of `DEPTH` rows, whose
counters saturate at 2. Its width grows with the corpus, so a batch's sketch is sparse and travels as its
non-zero cells, dealt to blocks of cells; a block adds up the sketches of all batches and tells each batch
which of its cells reach 2. An anchor is repeated by estimate if its cells in all rows do. The sum never
underestimates, so a window whose anchor is not is unique. A second pass groups exactly the windows that are
left, so nothing is lost and nothing unique is removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm import _text as T
from yieldspark.llm._repeats import Windows, repeated
from yieldspark.llm._spark import table

DEPTH = 2
#: Bytes of text for a counter of a row: about 16 counters an anchor, as words have some 6 bytes and anchors some 14 words.
COUNTER_BYTES = 5
GRAM = 8


@dataclass(frozen=True)
class CountMin:
    """DEPTH rows of 2 ** bits counters; a key is a row's number and a cell's, in the top bits."""

    bits: int

    @classmethod
    def of(cls, total: int) -> CountMin:
        return cls(max(8, (total // COUNTER_BYTES).bit_length()))

    @property
    def shift(self) -> int:
        return 64 - self.bits - (DEPTH - 1).bit_length()

    def keys(self, hashes: np.ndarray) -> list[np.ndarray]:
        cell = lambda row: T.mix(hashes + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - self.bits)
        return [(np.uint64(row << self.bits) | cell(row)) << np.uint64(self.shift) for row in range(DEPTH)]


def _keep(text: bytes, removed: np.ndarray) -> tuple[int, int, str]:
    words, n = text.split(), int(removed.sum())
    return len(words), n, b" ".join(compress(words, (~removed).tolist()) if n else words).decode()


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Removes each word inside a window of `window` words that also starts elsewhere in the corpus.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), a row for each input
    row. Null, empty and blank texts have no words; a text under `window` words keeps all; the same row
    twice is a repeat of itself; a very long text goes through in pieces, with a mask of its words; other columns
    are ignored, whatever their names; an empty table gives none.
    """
    windows = Windows(window, min(GRAM, window), words=True)
    return repeated(docs, id_col, text_col, windows, CountMin.of, _keep, "n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
