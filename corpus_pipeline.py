"""The corpus pipeline: language ID, near-duplicates, decontamination, secret scans, mixing.

Each stage takes what its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm._spark import staged, table
from yieldspark.llm.decontamination import contamination
from yieldspark.llm.language_id import fit, predict
from yieldspark.llm.mixing import mixture
from yieldspark.llm.near_dedup import one_of_each
from yieldspark.llm.secret_scan import redact, secrets

#: Python on the main path of three stages, and a corpus model: SQL cannot express run().
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (no letter, or no text); fills lang from the model where it is null.

    Without a labelled text there is no model: lettered texts stay, as they are. Repeated rows stay; very
    long texts are read whole; ids are not read; an empty table gives none.
    """
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = predict(docs, model, carry=True).where("lang_pred != 'und'")
    row = out["row"]
    return out.select(*(F.coalesce(row[c], out["lang_pred"]).alias(c) if c == "lang" else row[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five words, similarity 0.8), of the least id; rows without a word stay.

    Rows count, not ids: rows that share an id are duplicates only by their texts, a null id comes after all
    others, of repeated rows one stays. A very long text is compared by the set of all its words' shingles. An
    empty table gives none.
    """
    return one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window; null and empty texts hold none. Repeated rows fare alike;
    very long texts are scanned whole; an empty table gives none."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), carry=True).where("n_hit = 0").select("row.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the text by a mark, and counts n_chars anew where there was one.

    Null and empty texts stay as they are, as do all other columns, whatever their names; repeated rows give
    repeated rows; very long texts are read whole; an empty table gives none.
    """
    found = secrets(docs, carry=True)
    row, spans = found["row"], found["spans"]
    hit = F.size(spans) > 0
    clean = found.select("row", F.when(hit, redact(row["text"], spans)).otherwise(row["text"]).alias("clean"), hit.alias("hit"))
    row = clean["row"]
    own = {"text": clean["clean"], "n_chars": F.when(clean["hit"], F.length(clean["clean"]).cast("long")).otherwise(row["n_chars"])}
    return clean.select(*(own.get(c, row[c]).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that token shares meet the targets; adds topic, n_tokens and weight (1 / probability).

    Input columns of these three names give way to them. Null values of source and lang are a value of their
    own; texts without a word get their cell's probability; a null id is always drawn; repeated rows fare
    alike; a very long text weighs all its words; an empty table gives none.
    """
    out = mixture(docs).where("mix.selected")
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "weight")]
    row, mixed = out["row"], out["mix"]
    return out.select(*(row[c].alias(c) for c in own), mixed["topic"].alias("topic"), mixed["n_tokens"].alias("n_tokens"), (1 / mixed["probability"]).alias("weight"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", hide_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
