"""SQL of the queries that an independent engine can express whole: the same rows without this folder's operators."""

from __future__ import annotations

from .divergence import MIN_DOCS, PRIOR, SCALE, TOP
from .quality import BASE_RULES, METHOD_RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
RATIOS = {
    "n_words": "n_words",
    "repeat_percent": "100.0 * n_repeat_words / n",
    "mean_word_chars": "word_chars / n",
    "symbols_per_word": "n_symbols / n",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "stop_word_ratio": "n_stop / n",
}


def _broken(rule) -> str:
    said = [f"{RATIOS[rule.measure]} < {rule.low}"] if rule.low is not None else []
    said += [f"{RATIOS[rule.measure]} > {rule.high}"] if rule.high is not None else []
    return "(" + " OR ".join(said) + ")"


def quality_rules() -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    failed = ", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in (*BASE_RULES, *METHOD_RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS gram FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM grams) WHERE n > 1),
inside AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY k),
m AS (SELECT k, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_filter(w, lambda x: list_contains({stop}, lower(rtrim(x, '.,;:!?'))))) AS n_stop FROM w),
r AS (SELECT m.*, coalesce(inside.n, 0) AS n_repeat_words, greatest(n_words, 1)::DOUBLE AS n FROM m LEFT JOIN inside USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(map(_broken, BASE_RULES))} AS base_failed, concat_ws(',', {failed}) AS failed_rules, concat_ws(',', {failed}) = '' AS kept FROM r"""


def decontamination() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    window = "array_to_string(w[i:i + m - 1], ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w, least(len({words}), 10) AS m FROM benchmark),
held AS (SELECT DISTINCT item, m, {window} AS said FROM b, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE m > 0),
sizes AS (SELECT DISTINCT m FROM held),
spans AS (SELECT k, i, m, {window} AS said FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS u(i)),
hits AS (SELECT DISTINCT k, i, m, item FROM spans JOIN held USING (m, said)),
places AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM hits, range(10) AS r(j) WHERE j < m GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (k) LEFT JOIN items USING (k)"""


def source_divergence() -> str:
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM grps g LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (t.total + {PRIOR} * l.v)::HUGEINT AS p, 1 + ({SCALE}::HUGEINT * (k.lang_n + {PRIOR})) // (l.lang_total + {PRIOR} * l.v)::HUGEINT AS q
  FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""


ORACLE = {"op1_quality_rules": quality_rules(), "op7_decontamination": decontamination(), "op11_source_divergence": source_divergence()}
