"""The further queries in the SQL of an independent engine."""

from __future__ import annotations

from harken.functions.text import MATERIALS
from harken.operators import baseline as bl
from harken.operators import intent, replies
from harken.plans.extended import CONFIGS, SPANS
from harken.plans.oracle import BELIEF, CATALOG, ITEMS, PLAYED, SESSIONS, TURNS, arr, ordered, over, pairs_of, q, tokens

UTTERED = f"""
u AS (SELECT conv_id AS sample_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn, coalesce(text, '') AS message FROM conversations WHERE role = 'user'),
ch AS (SELECT sample_id, turn, string_split_regex(regexp_replace(regexp_replace(message, {q(intent.SCAFFOLD)}, ' ', 'g'), {q(intent.LOOKING)}, ' '), '[;.]') AS parts FROM u),
pt AS (SELECT sample_id, turn, unnest(parts) AS raw, (generate_subscripts(parts, 1) - 1)::INT AS part FROM ch),
tx AS (SELECT sample_id, turn, part, trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS text FROM pt),
mn AS (SELECT text, unnest(ps) AS p, (generate_subscripts(ps, 1) - 1)::INT AS reading FROM (SELECT text, {ordered('ps')} AS ps FROM (SELECT text, {pairs_of('text')} AS ps FROM (SELECT DISTINCT text FROM tx WHERE length(text) >= 3)))),
rd AS (SELECT sample_id, turn, part, reading, text, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM tx JOIN mn USING (text) WHERE p <> 'feature=' || lower(text))"""


def said(c: str, limit: int = intent.TEXT_CHARS) -> str:
    return f"left(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' .;,\t\n'), {limit})"


def picked(words, at: str) -> str:
    return f"{arr(words)}[{at} + 1]"


WORD, OTHER = picked(MATERIALS, "l_partkey % 9"), picked(MATERIALS, "l_suppkey % 9")
PROPOSED = f"""
raw AS (SELECT l_orderkey AS session_id, (1 + l_linenumber % 3)::INT AS turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount)::INT AS ord, 'I would like ' || {WORD} || ' or  ' || {OTHER} || ', please' AS message,
  {picked(('add', 'Replace', 'remove', 'confirm', 'no_preference', 'explode'), 'l_suppkey % 6')} AS op, {picked(('material', 'material', 'material', 'feature', 'shape'), 'l_partkey % 5')} AS attribute,
  CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 7 = 1 THEN ' ' || {WORD} || '.' WHEN l_suppkey % 7 = 2 THEN {OTHER} ELSE {WORD} END AS value,
  CASE WHEN l_partkey % 11 = 0 THEN 'something else' WHEN l_partkey % 11 = 1 THEN '' ELSE upper({WORD}) END AS evidence,
  CASE WHEN l_partkey % 13 = 0 THEN 'avoid' WHEN l_partkey % 13 = 1 THEN NULL ELSE 'require' END AS polarity,
  CASE WHEN l_suppkey % 5 = 0 THEN 'soft' WHEN l_suppkey % 17 = 1 THEN 'loud' ELSE 'hard' END AS strength, l_discount * 10 AS confidence, CASE WHEN l_partkey % 3 = 0 THEN 'G 1' ELSE '' END AS g FROM lineitem),
cut AS (SELECT session_id, turn, ord, message, lower({said('op')}) AS op, lower({said('attribute')}) AS attribute, {said('value')} AS value, CASE WHEN {said('evidence')} <> '' THEN {said('evidence')} ELSE {said('message')} END AS evidence,
  CASE WHEN coalesce(polarity, '') = '' THEN 'require' ELSE lower({said('polarity')}) END AS polarity, CASE WHEN coalesce(strength, '') = '' THEN 'hard' ELSE lower({said('strength')}) END AS strength, coalesce(confidence, 1.0) AS confidence, lower({said('g', intent.GROUP_CHARS)}) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY ord) AS nth FROM raw) WHERE nth <= 8),
fit AS (SELECT *, count(*) OVER (PARTITION BY session_id, turn, g) AS n, max(confidence) OVER (PARTITION BY session_id, turn, g) AS best FROM cut WHERE list_contains({arr(intent.OPERATIONS)}, op) AND list_contains({arr(intent.ATTRIBUTES)}, attribute)
  AND polarity IN ('require', 'avoid') AND strength IN ('hard', 'soft') AND (value <> '' OR op IN ('no_preference', 'confirm')) AND confidence BETWEEN 0 AND 1 AND (confidence >= 0.55 OR g <> '' AND confidence >= 0.01) AND contains(lower(message), lower(evidence)))"""


def field(text: str) -> str:
    marked, plain = bl.bare_letters()
    return f"regexp_extract_all(regexp_replace(translate(lower(coalesce({text}, '')), {q(marked)}, {q(plain)}), '\\p{{M}}+', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


FIELDS = {"title": "title", "categories": "array_to_string(categories, ' ')", "features": "array_to_string(features, ' ')", "details": "said", "store": "store"}
POSTED = f""",
fielded AS (SELECT parent_asin, cat_pos, {', '.join(f'{field(t)} AS f_{n}' for n, t in FIELDS.items())} FROM catalog),
sized AS (SELECT *, {' + '.join(f'len(f_{n})' for n in FIELDS)} AS len FROM fielded),
posted AS (SELECT term, parent_asin, cat_pos, len, sum(w) AS weight FROM ({' UNION ALL '.join(f'SELECT unnest(f_{n}) AS term, parent_asin, cat_pos, len, {bl.FIELDS[n]}::DOUBLE AS w FROM sized' for n in FIELDS)}) GROUP BY 1, 2, 3, 4),
whole AS (SELECT count(*) AS n, avg(len) AS al FROM sized),
weighted AS (SELECT term, greatest(1e-6, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM posted, whole GROUP BY term),
qterms AS (SELECT opener, unnest({ordered('t')}[1:40]) AS term FROM (SELECT opener, list_filter(regexp_extract_all(lower(opener), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({arr(bl.STOPWORDS)}, w)) AS t FROM (SELECT DISTINCT opener FROM openers))),
scored_q AS (SELECT opener, parent_asin, cat_pos, sum(idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM qterms JOIN posted USING (term) JOIN weighted USING (term), whole GROUP BY 1, 2, 3)"""
VALUES = ", ".join(f"({', '.join(q(x) if isinstance(x, str) else str(x) for x in r)})" for r in SPANS)
MATCHED = f""",
pair_i AS (SELECT DISTINCT parent_asin, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT parent_asin, unnest({pairs_of('s')}) AS p FROM (SELECT parent_asin, trim(unnest(spec)) AS s FROM items))),
wt AS (SELECT text, len(t) AS n, unnest(t) AS token FROM (SELECT text, {tokens('text')} AS t FROM (SELECT DISTINCT text FROM asked))),
ht AS (SELECT parent_asin, unnest({tokens('s')}) AS token FROM (SELECT parent_asin, array_to_string(spec, ' ') || ' ' || title AS s FROM items)),
lx AS (SELECT text, parent_asin, count(*) / max(n) * 0.9 / 3.2 AS s FROM wt JOIN ht USING (token) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.34)"""
CONFIG = ", ".join(f"({q(n)}, {c.get('v_continue', 0.75)}, {c.get('turn_cost', 0.0667)}, {c.get('stall_decay_clean', 0.8)}, {c.get('deadline', 3)}, {c.get('exclude_shipped', True)})" for n, c in CONFIGS.items())
KNOWN = """,
seen AS (SELECT sample_id, turn, list_position(own, pool_pos) AS rank FROM member JOIN convs v USING (c) JOIN lists USING (c) LEFT JOIN (SELECT opener, parent_asin AS item, pool_pos FROM pool) p ON p.opener = v.opener AND p.item = member.parent_asin WHERE turn > 0)"""
LIVE = """SELECT '{0}' AS erase, at_turn, count(*) AS n_live, round(sum(weight), 6) AS weight FROM member JOIN (SELECT h.c, t::INT AS at_turn, pow(0.9, t - turn) * CASE WHEN turn <= 1 AND demoted_turn <= t THEN {1} ELSE 1.0 END AS weight
  FROM {2} h LEFT JOIN turned USING (c), range(1, 11) r(t) WHERE t >= turn AND NOT ('{0}' = 'delete' AND turn <= 1 AND coalesce(demoted_turn, 99) <= t)) USING (c) GROUP BY 2"""
AGAIN = """,
again AS (SELECT n.*, demoted_turn, coalesce(n.turn >= demoted_turn, false) AS late FROM numbered n LEFT JOIN turned USING (c)),
ranked_again AS (SELECT *, row_number() OVER (PARTITION BY c, reading = 0, text, late ORDER BY turn, part, reading) AS nl, min(turn) OVER (PARTITION BY c, reading = 0, text) AS ft FROM again),
held_again AS (SELECT c, turn FROM ranked_again WHERE CASE WHEN reading = 0 THEN nl = 1 AND NOT (late AND ft > 1 AND ft < demoted_turn) ELSE nv = 1 END)"""

ORACLE: dict[str, str] = {
    "prose_readings": over(UTTERED, "SELECT * FROM rd"),
    "tiered_constraints": over(UTTERED, "SELECT sample_id, turn, part, reading, text, attribute, value, 'ontology' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, attribute, value ORDER BY turn, part, reading) AS r FROM rd) WHERE r = 1"),
    "slot_ages": over(TURNS, "SELECT attribute, at_turn, age, count(*) AS n_sessions FROM member JOIN (SELECT c, attribute, t::INT AS at_turn, (t - max(turn))::INT AS age FROM held, range(1, 11) r(t) WHERE turn <= t GROUP BY c, attribute, t) USING (c) GROUP BY 1, 2, 3"),
    "override_modes": over(TURNS + AGAIN, " UNION ALL ".join([LIVE.format("demote", 0.35, "held"), LIVE.format("delete", 1.0, "held_again"), LIVE.format("keep", 1.0, "held")])),
    "baseline_terms": f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({arr(bl.STOPWORDS)}, w)) AS t FROM documents)",
    "field_search": over(SESSIONS + POSTED, "SELECT opener AS query, rank, parent_asin, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY opener ORDER BY round(score, 9) DESC, cat_pos) AS rank FROM scored_q) WHERE rank <= 10"),
    "reply_sentences": over(BELIEF, f"SELECT opener, text, CASE WHEN NOT contains(opener, '. A key requirement is: ') THEN {q(replies.HOLD)} WHEN entropy < 0.55 THEN {q(replies.SURE)} ELSE {q(replies.CLOSEST)} END || ' ' || {q(replies.QUESTIONS['other'])} AS message FROM "
        "(SELECT opener, text, round(CASE WHEN count(*) > 1 THEN -sum(x * ln(x)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT opener, text, e / sum(e) OVER (PARTITION BY opener, text) AS x FROM beliefs) GROUP BY 1, 2)"),
    "rendered_templates": over(TURNS, "SELECT kind, count(*) AS n, sum(same)::BIGINT AS n_same FROM member JOIN (SELECT c, CASE WHEN kind <> 'opener' THEN kind WHEN scenario_type = 'buying' THEN 'buying' WHEN scenario_type = 'intent_override' THEN 'override_open' ELSE 'browsing' END AS kind, "
        "coalesce((message = CASE kind WHEN 'opener' THEN 'I''m looking for ' || category || CASE WHEN scenario_type = 'buying' THEN '. A key requirement is: ' || texts[1] || '.' WHEN scenario_type = 'intent_override' THEN '. ' || array_to_string(texts, '; ') ELSE ', but I''m still exploring.' END "
        "WHEN 'reply' THEN 'For that, what matters is: ' || array_to_string(list_transform(list_filter(texts, lambda v, i: list_position(texts, v) = i), lambda v: v), '; ') || '.' WHEN 'override' THEN 'Actually, ignore my earlier preference. What I need is: ' || array_to_string(texts, '; ') || '.' "
        "ELSE 'I don''t have an additional preference for other.' END)::INT, 0) AS same FROM told JOIN heard USING (c, turn, kind) JOIN convs USING (c)) USING (c) GROUP BY 1"),
    "state_json": over(TURNS, "SELECT sample_id, state FROM member JOIN (SELECT c, to_json({'turn': 4, 'category': category, 'recent_messages': ms, 'active': coalesce(act, [])})::VARCHAR AS state FROM convs JOIN (SELECT c, list(message ORDER BY turn) AS ms FROM play WHERE turn <= 4 GROUP BY c) USING (c) "
        "LEFT JOIN (SELECT c, list({'attribute': attribute, 'value': value, 'turn': turn} ORDER BY turn, part, reading) AS act FROM held WHERE turn <= 4 GROUP BY c) USING (c)) USING (c)"),
    "validated_proposals": over(PROPOSED, "SELECT session_id, turn, ord, op, attribute, value, evidence, polarity, strength, round(confidence, 6) AS confidence, g AS span_group FROM fit WHERE confidence >= 0.55 OR g <> '' AND n > 1 AND best >= 0.55"),
    "ambiguity_mixtures": over(CATALOG + f", asked(span, text, attribute, value, confidence, polarity) AS (VALUES {VALUES})" + MATCHED + """,
found AS (SELECT span, text, attribute, value, confidence, polarity, parent_asin, max(s) AS s FROM (SELECT a.*, parent_asin, 1.5 / 3.2 AS s FROM asked a JOIN pair_i USING (attribute, value) UNION ALL SELECT a.*, parent_asin, s FROM asked a JOIN lx USING (text)) GROUP BY ALL),
mass AS (SELECT span, sum(confidence) AS m FROM (SELECT DISTINCT span, text, attribute, value, confidence FROM found) GROUP BY 1),
mixed AS (SELECT span, parent_asin, sum(confidence * (CASE WHEN polarity = 'avoid' THEN greatest(0.02, exp(-3.2 * s)) - 1 ELSE greatest(0.02, exp(3.2 * (s - 1))) - exp(-3.2) END)) AS lift, max(CASE WHEN polarity = 'avoid' THEN 1.0 ELSE exp(-3.2) END) AS none FROM found GROUP BY 1, 2)""",
        "SELECT span, count(*) AS n_items, round(sum(ln(greatest(1e-12, none + lift / m)) - ln(none)), 4) AS total FROM mixed JOIN mass USING (span) GROUP BY 1"),
    "fused_lists": over(BELIEF + "," + PROPOSED + """,
prop AS (SELECT *, g <> '' AND count(*) OVER (PARTITION BY session_id, turn, g) > 1 AS unsure FROM fit WHERE confidence >= 0.55 OR g <> '' AND n > 1 AND best >= 0.55),
cons AS (SELECT session_id, value AS text, attribute, value, polarity, min(turn) AS turn, max(confidence) AS confidence, min(strength) AS strength FROM prop WHERE NOT unsure AND op IN ('add', 'replace') AND value <> '' GROUP BY 1, 2, 3, 4, 5),
alts AS (SELECT session_id, turn, g, value AS text, attribute, value, pol AS polarity, max(confidence) AS confidence FROM (SELECT *, arg_min(polarity, ord) OVER (PARTITION BY session_id, turn, g) AS pol FROM prop WHERE unsure) WHERE value <> '' GROUP BY 1, 2, 3, 4, 5, 6, 7),
ended AS (SELECT DISTINCT a.session_id, a.turn, a.g FROM alts a JOIN cons c USING (session_id, attribute, value) WHERE c.turn > a.turn),
open_spans AS (SELECT * FROM alts ANTI JOIN ended USING (session_id, turn, g)),
mine AS (SELECT sample_id AS session_id, opener FROM opened WHERE sample_id IN (SELECT session_id FROM cons UNION ALL SELECT session_id FROM open_spans)),
asked AS (SELECT DISTINCT text, attribute, value FROM (SELECT text, attribute, value FROM cons UNION ALL SELECT text, attribute, value FROM open_spans))""" + MATCHED + """,
xx AS (SELECT DISTINCT unnest(card) AS text, parent_asin FROM items),
found AS (SELECT text, attribute, value, parent_asin, max(s) AS s, max(soft) AS soft FROM (SELECT a.*, parent_asin, 1.5 / 3.2 AS s, 1.5 / 3.2 AS soft FROM asked a JOIN pair_i USING (attribute, value) UNION ALL SELECT a.*, parent_asin, s, s FROM asked a JOIN lx USING (text) UNION ALL SELECT a.*, parent_asin, 1.0, NULL FROM asked a JOIN xx USING (text)) GROUP BY ALL),
sure AS (SELECT session_id, parent_asin, pool_pos, pow(0.9, 3 - turn) * CASE WHEN strength = 'soft' THEN 0.7 ELSE 1 END * confidence * CASE WHEN polarity = 'avoid' THEN ln(greatest(0.02, exp(-3.2 * s))) ELSE ln(greatest(0.02, exp(3.2 * (s - 1)))) + 3.2 END AS e
  FROM cons JOIN mine USING (session_id) JOIN found USING (text, attribute, value) JOIN pool USING (opener, parent_asin)),
meant AS (SELECT session_id, turn, g, text, attribute, value, confidence, polarity, parent_asin, pool_pos, soft FROM open_spans JOIN mine USING (session_id) JOIN found USING (text, attribute, value) JOIN pool USING (opener, parent_asin) WHERE soft IS NOT NULL),
mass AS (SELECT session_id, turn, g, sum(confidence) AS m FROM (SELECT DISTINCT session_id, turn, g, text, attribute, value, confidence FROM meant) GROUP BY 1, 2, 3),
lifted AS (SELECT session_id, turn, g, parent_asin, pool_pos, sum(confidence * (CASE WHEN polarity = 'avoid' THEN greatest(0.02, exp(-3.2 * soft)) - 1 ELSE greatest(0.02, exp(3.2 * (soft - 1))) - exp(-3.2) END)) AS lift, max(CASE WHEN polarity = 'avoid' THEN 1.0 ELSE exp(-3.2) END) AS none FROM meant GROUP BY 1, 2, 3, 4, 5),
told_e AS (SELECT session_id, parent_asin, pool_pos, e FROM sure UNION ALL SELECT session_id, parent_asin, pool_pos, pow(0.9, 3 - turn) * 0.7 * (ln(greatest(1e-12, none + lift / m)) - ln(none)) FROM lifted JOIN mass USING (session_id, turn, g)),
every AS (SELECT session_id, parent_asin, p.pool_pos, round(coalesce(sum(e), 0), 9) AS e FROM mine JOIN pool p USING (opener) LEFT JOIN told_e t USING (session_id, parent_asin) GROUP BY 1, 2, 3)""",
        "SELECT session_id, rank, parent_asin, round(e, 5) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY e DESC, pool_pos) AS rank FROM every) WHERE rank <= 10"),
    "routed_turns": f"""WITH raw AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS turn, 'Looking for ' || {WORD} || ' things; what about  it?' AS message,
  {picked(('buying', 'browsing', 'override_open', 'reply', 'override', 'no_preference', 'null_ask', 'unknown', 'unknown'), 'l_partkey % 9')} AS kind, {picked(('deterministic', 'hybrid', '', ''), 'l_suppkey % 4')} AS way,
  CASE WHEN l_suppkey % 3 = 0 THEN {OTHER} WHEN l_suppkey % 3 = 1 THEN upper({WORD}) ELSE '' END AS named, {picked(('material', 'color', '', ''), 'l_partkey % 4')} AS attribute, CASE WHEN l_partkey % 5 = 0 THEN 'it is ' || {WORD} END AS norm,
  CASE WHEN l_suppkey % 2 <> 0 THEN CAST([] AS VARCHAR[]) WHEN {WORD} = {OTHER} THEN [{WORD}] ELSE [{WORD}, {OTHER}] END AS texts, l_suppkey % 2 = 0 AS acts FROM lineitem),
cut AS (SELECT *, CASE WHEN contains(lower(message), lower(named)) THEN named ELSE '' END AS category, CASE WHEN way <> '' THEN way WHEN kind <> 'unknown' OR acts THEN 'hybrid' ELSE 'deterministic' END AS route, array_to_string(texts, '; ') AS blob FROM raw),
told AS (SELECT *, CASE WHEN kind = 'buying' AND category <> '' AND len(texts) > 0 THEN 'I''m looking for ' || category || '. A key requirement is: ' || texts[1] || '.' WHEN kind = 'browsing' AND category <> '' THEN 'I''m looking for ' || category || ', but I''m still exploring.'
  WHEN kind = 'override_open' AND category <> '' AND len(texts) > 0 THEN 'I''m looking for ' || category || '. ' || blob WHEN kind = 'reply' AND len(texts) > 0 THEN 'For that, what matters is: ' || blob || '.' WHEN kind = 'override' AND len(texts) > 0 THEN 'Actually, ignore my earlier preference. What I need is: ' || blob || '.'
  WHEN kind = 'no_preference' AND attribute <> '' THEN 'I don''t have an additional preference for ' || attribute || '.' WHEN kind = 'null_ask' THEN 'Those options are not quite right yet. Ask me about one specific attribute.' END AS restored FROM cut)
SELECT session_id, turn, kind, route, category, attribute, coalesce(norm, message) AS normalized, restored,
  coalesce(last_value(CASE WHEN kind IN ('buying', 'browsing') THEN kind WHEN kind IN ('override', 'override_open') THEN 'override' END IGNORE NULLS) OVER w, 'browsing') AS session_route, max(kind = 'override') OVER w AS override_seen,
  count(restored) OVER w AS n_restored, count(CASE WHEN kind <> 'unknown' THEN 1 END) OVER w AS n_understood FROM told WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "polarity_gains": over(CATALOG + f", asked AS (SELECT text, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT text, unnest({ordered('ps')}) AS p FROM (SELECT text, {pairs_of('trim(text)')} AS ps FROM card_texts)))" + MATCHED + """,
xx AS (SELECT DISTINCT unnest(card) AS text, parent_asin FROM items),
found AS (SELECT text, attribute, value, parent_asin, max(s) AS s FROM (SELECT a.*, parent_asin, 1.5 / 3.2 AS s FROM asked a JOIN pair_i USING (attribute, value) UNION ALL SELECT a.*, parent_asin, s FROM asked a JOIN lx USING (text) UNION ALL SELECT a.*, parent_asin, 1.0 FROM asked a JOIN xx USING (text)) GROUP BY ALL)""",
        "SELECT text, attribute, value, count(*) AS n_items, round(sum(ln(greatest(0.02, exp(3.2 * (s - 1)))) + 3.2), 3) AS require, round(sum(ln(greatest(0.02, exp(-3.2 * s)))), 3) AS avoid FROM found GROUP BY 1, 2, 3"),
    "known_curve": over(PLAYED + KNOWN, "SELECT k::BIGINT AS k, t::BIGINT AS turn, round(avg(CASE WHEN first <= t THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT sample_id, k, min(CASE WHEN rank > 0 AND rank <= k THEN turn END) AS first FROM seen, (VALUES (1), (3), (10)) v(k) GROUP BY 1, 2), range(1, 11) r(t) GROUP BY 1, 2"),
    "shipped_curve": over(PLAYED, "SELECT t::INT AS turn, round(avg(CASE WHEN first_hit_turn <= t THEN 1.0 ELSE 0.0 END), 6) AS share FROM played, range(1, 11) r(t) GROUP BY 1"),
    "stopping_bound": over(PLAYED + KNOWN, "SELECT round(a, 6) AS mttc, round(b, 6) AS oracle_mttc, round(0.2 * (greatest(0, least(1, (11 - round(b, 6)) / 10)) - greatest(0, least(1, (11 - round(a, 6)) / 10))), 6) AS gain FROM (SELECT avg(coalesce(first_hit_turn, 11)) AS a, avg(coalesce(knew, 11)) AS b "
        "FROM played JOIN (SELECT sample_id, min(CASE WHEN rank = 1 THEN turn END) AS knew FROM seen GROUP BY 1) USING (sample_id))"),
    "latency_percentiles": "SELECT event_type, l[least(n - 1, floor(n * 0.5)::INT) + 1] AS p50, l[least(n - 1, floor(n * 0.95)::INT) + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS l, count(*)::INT AS n FROM events WHERE value IS NOT NULL GROUP BY 1)",
    "token_usage": "SELECT p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM (SELECT sum(greatest(trunc(l_quantity - 10)::BIGINT, 0))::BIGINT AS p, sum(greatest(l_suppkey % 7 - 1, 0))::BIGINT AS c FROM lineitem)",
    "freeform_coverage": over(SESSIONS, "SELECT round(avg((sample_id % 3 = 0)::INT), 6) AS share FROM sessions"),
    "config_depths": over(TURNS + f", cfg(config, go_on, cost, decay, deadline, exclude) AS (VALUES {CONFIG})",
        "SELECT config, turn, depth, proven, count(*) AS n_sessions FROM member JOIN (SELECT config, s.c, s.turn, CASE WHEN scenario_type = 'intent_override' AND s.turn < least(deadline, ot) THEN 0 WHEN s.turn >= 10 THEN 10 ELSE (SELECT max(k) FROM range(1, 11) r(k) WHERE 1.0 / k > greatest(0, go_on * pow(decay, stalls) - cost)) END::INT AS depth, "
        "exclude AND (s.turn >= 4 OR scenario_type <> 'intent_override' OR s.turn >= ot) AS proven FROM stalled s JOIN convs USING (c), cfg) USING (c) GROUP BY 1, 2, 3, 4"),
    "jsonl_catalog": over(ITEMS, "SELECT parent_asin, array_to_string(hard, ' | ') AS hard, array_to_string(soft, ' | ') AS soft, array_to_string(spec, ' | ') AS spec, lexical_text, category, row_number() OVER (ORDER BY cat_pos) AS place FROM items"),
    "jsonl_transcripts": over(TURNS, "SELECT sample_id::VARCHAR AS sample_id, turn, CASE WHEN turn = 1 AND sample_id % 3 = 0 THEN 'after some ' || title ELSE message END AS message FROM member JOIN play USING (c) JOIN (SELECT parent_asin, title FROM items) USING (parent_asin)"),
}
