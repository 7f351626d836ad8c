"""Operator 6, mixing: token weights raked to marginals, then documents sampled by calibrated probabilities.

Documents fall in cells (a value of every dimension). Iterative proportional fitting scales the cells'
token weights to each dimension's target in turn, for ROUNDS rounds; a document's probability is its cell's
weight over its cell's tokens, scaled so that the largest is 1, so that the sample's expected token shares
are the targets, without clipping.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm._spark import row_of, staged, table

#: Cells that may be raked on the driver (a summary: one row a cell) and broadcast; beyond it Spark rakes.
DRIVER_CELLS = 100_000
ROUNDS = 20
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: A target is a weight for each value, or an exponent: shares in proportion to token shares to that power.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, "topic": 0.7}


def topic(text: Column) -> Column:
    """Kind of text: table, marked (symbol runs), short (under 50 words) or prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(" | "), "table").when(text.rlike(r"[#*$%&]{3}"), "marked").when(F.regexp_count(text, F.lit(WORD)) < 50, "short").otherwise("prose")


def _shares(of: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Target shares of the values that have tokens; a value without a target keeps its own share."""
    total = sum(of.values()) or 1.0
    if not isinstance(target, dict):
        raw = {k: (v / total) ** target for k, v in of.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}
    rest = sum(v for k, v in of.items() if k not in target) / total
    asked = sum(w for k, w in target.items() if k in of) or 1.0
    return {k: target[k] / asked * (1 - rest) if k in target else v / total for k, v in of.items()}


def _raked_here(cells: DataFrame, dims: tuple[str, ...], targets: dict, rounds: int) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in dims))
    tokens = np.array([r["tokens"] for r in rows], float)
    weight, places, goals = tokens.copy(), [], []
    for d in dims:
        names = sorted({r[d] for r in rows})
        at = {n: k for k, n in enumerate(names)}
        place = np.array([at[r[d]] for r in rows], int)
        share = _shares(dict(zip(names, np.bincount(place, tokens, len(names)).tolist(), strict=True)), targets[d])
        places.append(place)
        goals.append(np.array([share[n] for n in names]) * tokens.sum())
    for _ in range(rounds):
        for place, goal in zip(places, goals, strict=True):
            sums = np.bincount(place, weight, len(goal))
            weight *= np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[place]
    ratio = weight / tokens
    out = [(*(r[d] for d in dims), float(w)) for r, w in zip(rows, ratio / (ratio.max(initial=0) or 1.0), strict=True)]
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{d} string" for d in dims) + ", probability double")


def _raked_there(cells: DataFrame, dims: tuple[str, ...], targets: dict, rounds: int) -> DataFrame:
    """The same for any number of cells: each step is a grouped sum joined back; each round is staged."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0]
    goals = {}
    for d in dims:
        marginal = cells.groupBy(d).agg((F.sum("tokens") / total).alias("share"))
        if isinstance(targets[d], dict):
            asked = F.create_map(*(F.lit(x) for kv in targets[d].items() for x in kv))[F.col(d)]
            marginal = marginal.withColumn("asked", asked)
            rest = marginal.agg(F.coalesce(F.sum(F.when(F.col("asked").isNull(), F.col("share"))), F.lit(0.0)), F.sum("asked")).first()
            goal = F.coalesce(F.col("asked") / (rest[1] or 1.0) * (1 - rest[0]), F.col("share"))
        else:
            raw = marginal.agg(F.sum(F.pow("share", F.lit(targets[d])))).first()[0]
            goal = F.pow("share", F.lit(targets[d])) / raw
        goals[d] = marginal.select(d, (goal * total).alias("goal"))
    for _ in range(rounds):
        for d in dims:
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum")).join(goals[d], d)
            now = now.join(sums, d).withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col("goal") / F.col("sum")).otherwise(0.0)).drop("sum", "goal")
        now = staged(now, "cells")
    most = now.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 1.0
    return now.select(*dims, (F.col("weight") / F.col("tokens") / F.lit(most)).alias("probability"))


def mixture(docs: DataFrame, targets: dict[str, dict[str, float] | float] | None = None, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every input row with a struct `mix`: its cell's values, n_tokens, probability and selected.

    dims maps dimension names to columns (by default source, lang and topic()); a null value is the value
    "(none)". Documents without a word weigh nothing and get the probability of their cell, or 1 if no
    document of the cell has a word. A target of 0 gives its documents probability 0. Of very long texts all
    words count. selected depends on the id only (an md5 draw), so reruns and repeated
    rows agree; a null id draws 0. Input columns stay as they are, whatever their names; an empty table
    gives none.
    """
    targets = targets or TARGETS
    text = F.col(text_col).cast("string")
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(text)}
    names = tuple(dims)
    measured = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in dims.items()]
    tokens = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")
    draw = F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13), F.lit(0.0))
    rows = docs.select(row_of(docs)[0], draw.alias("draw"), tokens, *measured)
    cells = staged(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    small = cells.count() <= DRIVER_CELLS
    raked = (_raked_here if small else _raked_there)(cells, names, targets, rounds)
    out = rows.join(F.broadcast(raked) if small else raked, list(names), "left")
    chance = F.coalesce("probability", F.lit(1.0))
    return out.select("row", F.struct(*names, "n_tokens", chance.alias("probability"), (F.col("draw") < chance).alias("selected")).alias("mix"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"))
    mix = [F.col(f"mix.{c}").alias(c) for c in (*DIMENSIONS, "n_tokens")]
    return out.select(F.col("row.doc_id").alias("doc_id"), *mix, F.round("mix.probability", 9).alias("probability"), F.col("mix.selected").alias("selected"))


def _oracle() -> str:
    """The same in DuckDB, each raking step a CTE."""
    d = (
        r"WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,"
        r" len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,"
        r" CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{3}') THEN 'marked'"
        r" WHEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) < 50 THEN 'short' ELSE 'prose' END AS topic FROM documents),"
        " c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),"
    )
    asked = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TARGETS["lang"].items()) + " END"
    d += " t AS (SELECT sum(tokens) AS total FROM c0),"
    for dim in ("source", "topic"):
        d += f" g_{dim} AS MATERIALIZED (SELECT {dim}, total * pow(sum(tokens) / total, {TARGETS[dim]}::DOUBLE) / sum(pow(sum(tokens) / total, {TARGETS[dim]}::DOUBLE)) OVER () AS goal FROM c0, t GROUP BY {dim}, total),"
    d += f" l AS (SELECT lang, {asked} AS asked, sum(tokens) / total AS share FROM c0, t GROUP BY lang, total),"
    d += " g_lang AS MATERIALIZED (SELECT lang, total * CASE WHEN asked IS NULL THEN share ELSE asked / sum(asked) OVER () * (1 - coalesce(sum(CASE WHEN asked IS NULL THEN share END) OVER (), 0)) END AS goal FROM l, t),"
    k = 0
    for _ in range(ROUNDS):
        for dim in DIMENSIONS:
            d += f" c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * goal / sum(w) OVER (PARTITION BY {dim}) AS w FROM c{k} JOIN g_{dim} USING ({dim})),"
            k += 1
    d += f" p AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS probability FROM c{k}),"
    d += " u AS (SELECT d.*, coalesce(p.probability, 1) AS q, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / pow(16, 13), 0) AS draw FROM d LEFT JOIN p USING (source, lang, topic))"
    return d + " SELECT doc_id, source, lang, topic, n_tokens, round(q, 9) AS probability, draw < q AS selected FROM u"


ORACLE_SQL = _oracle()
