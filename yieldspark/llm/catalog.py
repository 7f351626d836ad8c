"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from yieldspark.llm.decontamination import op4_decontamination
from yieldspark.llm import fill_middle, hard_negatives, mixing, secret_scan
from yieldspark.llm.bpe import op13_bpe
from yieldspark.llm.html_wrapper import op5_html_extraction
from yieldspark.llm.language_id import op2_language_id
from yieldspark.llm.lm_scoring import op3_lm_scoring
from yieldspark.llm.near_dedup import op7_near_dedup
from yieldspark.llm.quality_rules import POLICIES, RULES, op8_quality_rules, quality_ablations
from yieldspark.llm.substring_dedup import op9_substring_dedup
from yieldspark.llm.suffix_dedup import op10_suffix_dedup

QUERIES = {f.__name__: f for f in (secret_scan.op1_secret_scan, op2_language_id, op3_lm_scoring, op4_decontamination, op5_html_extraction, mixing.op6_mixing, op7_near_dedup, op8_quality_rules, quality_ablations, op9_substring_dedup, op10_suffix_dedup, hard_negatives.op11_hard_negatives, fill_middle.op12_fill_in_middle, op13_bpe)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_MEASURED = rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS words, coalesce(text, '') AS t FROM documents),
        g AS (SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM d)),
        r0 AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM r0) GROUP BY 1),
        m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN c USING (doc_id)),
        l AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, chr(8226))))::BIGINT AS n_bullet_lines,
            len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230))))::BIGINT AS n_cut_lines, coalesce(list_max(list_transform(lines, lambda x: strlen(x))), 0)::BIGINT AS most_line_bytes FROM m),
        f AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))} AS bits FROM l)"""

#: DuckDB's own reading of the contracts. SQL has no lattice, kernel model, wrapper or merges: ops 2, 3, 5 and 13 have none.
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE_SQL,
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_BENCH} AS words FROM documents),
        i AS (SELECT item_id::VARCHAR AS item, {_BENCH} AS words FROM benchmark),
        iw AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS win
            FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS p FROM i WHERE len(words) > 0)),
        dw AS (SELECT doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') AS win
            FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
        h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, win)),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
        m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 2], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS p FROM d WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id != b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        low AS (SELECT x, min(y) AS m FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(m, d.doc_id) >= d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id""",
    "op8_quality_rules": _MEASURED + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) != 0 AS base_failed, (bits & 63) = 0 AS kept, (bits & 63)::BIGINT AS failed FROM f""",
    "quality_ablations": _MEASURED + ", r AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in POLICIES["v3"]) + f"""]) AS rule, unnest(range({len(POLICIES["v3"])})) AS k)
        SELECT rule, count(*) FILTER ((bits >> k) & 1 = 1) AS n_failed, count(*) FILTER (bits = 1 << k) AS n_only, count(*) FILTER (bits & ~(1 << k) = 0) AS n_kept_without FROM r, f GROUP BY 1""",
    "op9_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM d),
        k AS (SELECT doc_id, p, array_to_string(words[p:p + 34], ' ') AS win FROM s),
        r AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY win) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM r),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY q) AS t, count(*) AS n
            FROM (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(hex(text), '') AS h FROM documents),
        s AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2)::BIGINT - 199)) AS p FROM d),
        k AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS win FROM s),
        r AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY win) > 1),
        runs AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r),
        marks AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs),
        spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM marks GROUP BY ALL),
        cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM spans),
        sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS m, max(b) AS last FROM spans GROUP BY 1),
        parts AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM cuts JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN parts USING (doc_id)""",
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
}
