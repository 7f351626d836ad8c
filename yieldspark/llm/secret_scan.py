"""Operator 1, secret scans: credential patterns and sliding-window entropy, in DataFrame functions only.

Patterns: a match's place comes from cutting the text at the matches, as the lengths of the pieces and
matches before it add up. Entropy: every candidate string (a long run of token characters) is read once by
a fold whose state is the counts of the current window, so each step subtracts the leaving character and
adds the entering one; n log n sums are kept, never recounted. A candidate is a span where some window's
Shannon entropy reaches its character class's threshold, unless the allow-list covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldspark.llm._spark import row_of, table

#: kind -> pattern, group whose length counts, least length.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: What a text must hold for the pattern to be tried; for hex, failing runs never matter, so it may ask for the length.
NEEDED: dict[str, str] = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class -> (strings of the class, bits a character that some window must reach); the first that fits counts.
CLASSES: dict[str, tuple[str, float]] = {
    "hex": (r"^[0-9a-fA-F]+$", 3.0),
    "alnum": (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.7),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.9),
}
#: Classes of the candidates that are left, as CLASSES. mixed: letters whose case changes too often for words.
LEFT: dict[str, tuple[str, float]] = {
    "token": (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.8),
    "mixed": (r"^(?=.*(?:[a-z][A-Z][A-Za-z]{0,2}){4})[A-Za-z+/_=-]+$", 4.0),
}
#: Candidates that are never secrets: digits and separators, UUIDs, words joined by separators, placeholders.
ALLOWED: tuple[str, ...] = (
    r"^[0-9_=/+-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([_/=+-]+([A-Za-z]+|[0-9]{1,4}))*$",
    r"(?i)example|placeholder|changeme|your[_-]|x{6,}|0{8,}",
)
#: The last of ALLOWED covers what it matches, not the candidate around it. Words joined by separators are allowed in every class but mixed.
WORDS, PLACEHOLDER = ALLOWED[2], ALLOWED[3]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:long,end:long,kind:string>>"


def _spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """start, end (code points) and kind of the leftmost non-overlapping matches whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(group + 1)) if group else found
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), F.zip_with(found, sized, lambda f, s: F.struct(F.length(f).alias("f"), F.length(s).alias("s"))), lambda p, m: F.struct(F.length(p).alias("p"), m["f"].alias("f"), m["s"].alias("s")))
    start = lambda a, x: a["at"] + x["p"]
    one = lambda a, x: F.array(F.struct(start(a, x).alias("start"), (start(a, x) + x["f"]).alias("end"), F.lit(kind).alias("kind")))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct((start(a, x) + x["f"]).alias("at"), F.when(x["s"] >= least, F.concat(a["out"], one(a, x))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy (bits a character) of `window` consecutive characters of the token."""
    code = lambda at: F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1)))
    size = F.length(token)

    def bump(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda n, k: F.when(k == code(at) - 1, n + by).otherwise(n))

    def count(counts: Column, at: Column) -> Column:
        return F.coalesce(F.get(counts, code(at) - 1), F.lit(0))

    def step(state: Column, at: Column) -> Column:
        leaves = at - window
        gone = F.when(leaves > 0, bump(state["counts"], leaves, -1)).otherwise(state["counts"])
        old = count(state["counts"], leaves)
        total = F.when(leaves > 0, state["total"] - _nlogn(old) + _nlogn(old - 1)).otherwise(state["total"])
        here = count(gone, at)
        total = total - _nlogn(here) + _nlogn(here + 1)
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(bump(gone, at, 1).alias("counts"), total.alias("total"), F.when(at >= window, F.greatest(state["most"], bits)).otherwise(state["most"]).alias("most"))

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), zero, step, lambda s: s["most"])


def _entropy_spans(text: Column) -> Column:
    """Spans of kind entropy_<class> among the candidate strings."""
    found = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))
    places = _spans(text, CANDIDATE, "entropy", 0, 0)
    pairs = F.zip_with(places, found, lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t.alias("token")))
    found_ = F.transform(pairs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("entropy_"), _candidate_class(x["token"])).alias("kind")))
    return F.filter(found_, lambda x: x["kind"].isNotNull())


def _candidate_class(token: Column) -> Column:
    """Class of the first part of the candidate, between placeholders, that is a secret; null if none is."""
    parts = F.filter(F.split(token, PLACEHOLDER), lambda p: F.length(p) >= WINDOW)
    return F.when(token.rlike(PLACEHOLDER), F.get(F.filter(F.transform(parts, _secret_class), lambda k: k.isNotNull()), F.lit(0))).otherwise(_secret_class(token))


def _secret_class(token: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        if pattern not in (WORDS, PLACEHOLDER):
            allowed = allowed | token.rlike(pattern)
    kind, least = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (pattern, bits) in reversed((CLASSES | LEFT).items()):
        own = token.rlike(pattern) if name == "mixed" else token.rlike(pattern) & ~token.rlike(WORDS)
        kind, least = F.when(own, name).otherwise(kind), F.when(own, bits).otherwise(least)
    return F.when(kind.isNotNull() & ~allowed, F.when(window_entropy(token) >= least, kind))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and `spans`: start, end (code points, end exclusive) and kind of every secret, in order.

    Kinds: assign, access, hex (patterns) and entropy_<class>. Spans of different kinds may overlap. Null
    and empty texts have none; a very long text is read whole. With carry, the input row comes along as a
    struct `row`. Repeated rows give repeated rows; other columns are ignored; an empty table gives none. The order is by start, then kind as listed here, then end.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([row_of(docs)[0]] if carry else []))
    none = F.array().cast(SPAN)
    kinds = [F.when(F.col("text").rlike(NEEDED[k]), _spans(F.col("text"), p, k, group, least)).otherwise(none) for k, (p, group, least) in PATTERNS.items()]
    entropy = F.when(F.col("text").rlike(CANDIDATE), _entropy_spans(F.col("text"))).otherwise(none)
    order = [*PATTERNS, *(f"entropy_{c}" for c in CLASSES | LEFT)]
    keyed = F.transform(F.concat(*kinds, entropy), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(order), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select(*(["row"] if carry else []), "doc_id", F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal union of spans replaced by the mark; spans as secrets() orders them."""

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], piece, F.lit(mark))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, cut, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(n(k) for k in PATTERNS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same in DuckDB: places by splitting, entropy anew for every window."""
    text = lambda s: s.replace("'", "''")
    kinds = [(k, p, g, n) for k, (p, g, n) in PATTERNS.items()] + [("entropy", CANDIDATE, 0, 0)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {n} AS least, regexp_extract_all(t, '{text(p)}') AS f, regexp_extract_all(t, '{text(p)}', {g}) AS s, string_split_regex(t, '{text(p)}') AS p FROM d WHERE regexp_matches(t, '{text(p)}')" for k, p, g, n in kinds
    )
    allowed = " OR ".join(f"regexp_matches(token, '{p}')" for p in ALLOWED if p not in (WORDS, PLACEHOLDER))
    digit, letter = "regexp_matches(token, '[0-9]')", "regexp_matches(token, '[A-Za-z]')"
    hits = {
        "hex": "regexp_full_match(token, '[0-9a-fA-F]+')",
        "alnum": f"regexp_full_match(token, '[A-Za-z0-9]+') AND {digit} AND {letter}",
        "base64": f"{digit} AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[a-z]')",
        "token": f"{digit} AND {letter}",
        "mixed": f"NOT {digit} AND regexp_matches(token, '([a-z][A-Z][A-Za-z]{{0,2}}){{4}}')",
    }
    classes = CLASSES | LEFT
    words = f"NOT regexp_matches(token, '{WORDS}') AND "
    case = "CASE " + " ".join(f"WHEN {'' if k == 'mixed' else words}{hits[k]} THEN '{k}'" for k in classes) + " END"
    least = "CASE cls " + " ".join(f"WHEN '{k}' THEN {bits}" for k, (_, bits) in classes.items()) + " END"
    place = [*PATTERNS, *(f"entropy_{c}" for c in classes)]
    n = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS ({found}), i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM g),
        m AS (SELECT doc_id, kind, least, f[i] AS token, length(s[i]) AS size, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a FROM i),
        q AS (SELECT doc_id, a, length(token) AS whole, CASE WHEN regexp_matches(token, '{PLACEHOLDER}') THEN list_filter(string_split_regex(token, '{PLACEHOLDER}'), lambda x: length(x) >= {WINDOW}) ELSE [token] END AS parts FROM m WHERE kind = 'entropy'),
        p AS (SELECT doc_id, a, whole, unnest(parts) AS token, unnest(range(1, len(parts) + 1)) AS nth FROM q),
        c AS (SELECT doc_id, a, whole, nth, token, {case} AS cls FROM p WHERE NOT ({allowed})),
        w AS (SELECT doc_id, a, whole, nth, cls, max(list_aggregate(string_split(substr(token, o, {WINDOW}), ''), 'entropy')) AS h FROM (SELECT *, unnest(range(1, length(token) - {WINDOW} + 2)) AS o FROM c WHERE cls IS NOT NULL) GROUP BY ALL),
        e AS (SELECT doc_id, a, whole, min_by(cls, nth) AS cls FROM w WHERE h >= {least} GROUP BY doc_id, a, whole),
        s AS (SELECT doc_id, kind, a::BIGINT AS a, (a + length(token))::BIGINT AS b FROM m WHERE kind != 'entropy' AND size >= least UNION ALL SELECT doc_id, 'entropy_' || cls, a::BIGINT, (a + whole)::BIGINT FROM e),
        o AS (SELECT *, list_position({place}, kind) AS k, kind || ':' || a || ':' || b AS span FROM s),
        r AS (SELECT doc_id, {', '.join(map(n, PATTERNS))}, string_agg(span, ',' ORDER BY a, k, b) FILTER (k <= {len(PATTERNS)}) AS base, string_agg(span, ',' ORDER BY a, k, b) AS spans FROM o GROUP BY 1)
        SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)"""


ORACLE_SQL = _oracle()
