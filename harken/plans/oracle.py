"""The same queries in the SQL of an independent engine, for comparison."""

from __future__ import annotations

from harken.functions import text as tx
from harken.operators import catalog as cat
from harken.operators import vocabulary as voc
from harken.sources import views


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


STOP = arr(tx.STOPWORDS)


def clean(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9%$. /&-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .-/')"


def tokens(t: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))"


def terms(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9\\-.]*%?'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def stems(t: str) -> str:
    for pattern, said in tx.CATEGORY_ALIASES:
        t = f"regexp_replace({t}, {q(pattern)}, {q(said)}, 'g')"
    return f"list_distinct(list_transform({tokens(t)}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END))"


def any_of(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def classify(t: str) -> str:
    low = f"lower({t})"
    return f"CASE WHEN contains({low}, 'budget') OR regexp_matches({low}, '(\\$|<=|under)\\s*\\d') THEN 'budget' " + " ".join(f"WHEN {any_of(low, w)} THEN {q(n)}" for n, w in tx.CLASS_WORDS) + " ELSE 'feature' END"


def key_of(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({t})', w)} THEN {q(n)}" for n, w in tx.KEY_HINTS.items()) + " END"


def ordered(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def pairs_of(t: str) -> str:
    """A list of 'attribute=value' readings of the trimmed text t, in order."""
    key, rest = f"split_part({t}, ':', 1)", f"substr({t}, position(':' IN {t}) + 1)"
    cond = f"contains({t}, ':') AND trim({rest}) <> '' AND length({key}) <= 40 AND {key_of(key)} IS NOT NULL AND {clean(rest)} <> ''"
    found = [f"CASE WHEN {cond} THEN {key_of(key)} || '=' || left({clean(rest)}, 60) END"]
    for name, pattern in (("material", tx.MATERIAL), ("color", tx.COLOR)):
        found.append(f"CASE WHEN regexp_matches({t}, {q(pattern)}) THEN '{name}=' || lower(regexp_extract({t}, {q(pattern)}, 1)) END")
    found.append(f"CASE WHEN regexp_matches({t}, {q(tx.PRICE)}) THEN 'budget=' || regexp_extract({t}, {q(tx.PRICE)}, 1) END")
    for pattern, name in tx.CUES:
        value = clean(f"regexp_extract({t}, {q(pattern)}, 1)")
        found.append(f"CASE WHEN {value} <> '' THEN '{name}=' || left({value}, 60) END")
    own = f"list_filter([{', '.join(found)}], lambda p: p IS NOT NULL)"
    rest_ = f"CASE WHEN {clean(t)} <> '' THEN [{classify(t)} || '=' || left({clean(t)}, 60)] ELSE CAST([] AS VARCHAR[]) END"
    return f"CASE WHEN len({own}) > 0 THEN {own} ELSE {rest_} END"


def folded(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^a-z0-9%$]+', ' ', 'g'))"


def alias_of(a: str, k: str) -> str:
    return f"CASE {a} || '=' || {k} " + " ".join(f"WHEN {q(f'{x}={y}')} THEN {q(z)}" for x, m in voc.ALIASES.items() for y, z in m.items()) + f" ELSE {k} END"


def concept_of(source: str) -> str:
    """(…, attribute, value) rows of the source with their concept."""
    own = f"(list_filter({pairs_of('trim(value)')}, lambda p: split_part(p, '=', 1) = attribute))[1]"
    said = "coalesce(nullif(substr(own, length(attribute) + 2), ''), value)"
    first = f"SELECT *, {folded(said)} AS k FROM (SELECT *, {own} AS own FROM {source})"
    plain = "trim(replace(replace(c, 'made entirely of ', ''), 'entirely ', ''))"
    return f"(SELECT *, CASE WHEN attribute = 'material' AND contains(c, 'entirely') THEN {plain} ELSE c END AS concept FROM (SELECT *, {alias_of('attribute', 'k')} AS c FROM ({first})))"


CLEAN_CONSTRAINT = "rtrim(left(trim(regexp_replace(x, '\\s+', ' ', 'g'), ' -;,.\t\n'), 180))"
NONE = arr(cat.NO_CATEGORY)
CATALOG = f"""
sold AS (SELECT l_partkey AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
catalog AS (
  SELECT 'P' || p_partkey AS parent_asin, p_partkey AS cat_pos, p_name AS title, p_brand AS store,
    ['Clothing, Shoes & Jewelry', p_type, split_part(p_name, ' ', 2)] AS categories,
    CASE WHEN p_partkey % 3 <> 0 THEN [(50 + p_partkey % 51) || '% ' || {arr(tx.MATERIALS)}[p_partkey % 9 + 1], {arr(views.CLOSURES)}[p_size % 4 + 1]] ELSE [{arr(views.CLOSURES)}[p_size % 4 + 1]] END AS features,
    ['Department: ' || p_type, 'Item Size: ' || p_size] AS details, 'Department ' || p_type || ' Item Size ' || p_size AS said,
    p_retailprice::VARCHAR AS price, coalesce(n, 0) AS rating_number
  FROM part LEFT JOIN sold ON k = p_partkey),
parts AS (SELECT *, list_filter(flatten(list_transform(categories, lambda c: list_transform(string_split(c, ','), lambda p: trim(p)))), lambda p: p <> '' AND NOT list_contains({NONE}, lower(p))) AS cats,
    concat_ws(' ', title, array_to_string(features, ' '), said, array_to_string(categories, ' '), store) AS corpus FROM catalog),
words AS (SELECT *, lower(regexp_extract(corpus, {q(tx.MATERIAL)}, 1)) AS material, lower(regexp_extract(corpus, {q(tx.COLOR)}, 1)) AS color FROM parts),
c1 AS (SELECT *, CASE WHEN material <> '' THEN [material] ELSE CAST([] AS VARCHAR[]) END || features || details AS a FROM words),
c2 AS (SELECT *, CASE WHEN color <> '' THEN a[1:1] || ['color: ' || color] || a[2:] ELSE a END || ['budget around $' || price] AS b FROM c1),
c3 AS (SELECT *, list_filter(list_transform(b, lambda x: {CLEAN_CONSTRAINT}), lambda x: x <> '') AS c FROM c2),
c4 AS (SELECT *, {ordered('c')} AS strings FROM c3),
idx AS (SELECT parent_asin, cat_pos, title, store, features, rating_number, ln(1 + rating_number) AS log_pop, CASE WHEN len(cats) > 0 THEN array_to_string(cats[-2:], ' ') ELSE 'clothing item' END AS category,
    strings[1:2] AS hard, CASE WHEN len(strings) > 2 THEN strings[3:4] ELSE strings[1:1] END AS soft, features || details AS spec,
    concat_ws(' ', title, store, array_to_string(categories, ' '), array_to_string(features[1:8], ' ')) AS lexical_text FROM c4),
items AS (SELECT *, hard || soft AS card FROM idx),
card_texts AS (SELECT DISTINCT unnest(card) AS text FROM items)"""
SAMPLES = """,
samples AS (SELECT o_orderkey AS sample_id, t AS target_pos, CASE WHEN o_orderkey % 20 < 8 THEN 'buying' WHEN o_orderkey % 20 < 16 THEN 'browsing' WHEN o_orderkey % 20 < 19 THEN 'intent_override' ELSE 'boundary' END AS scenario_type,
  (3 + o_orderkey % 2)::INT AS override_turn FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
sessions AS (SELECT s.*, parent_asin, category, hard, soft, card FROM samples s JOIN items ON cat_pos = target_pos),
opened AS (SELECT *, 'I''m looking for ' || category || CASE WHEN scenario_type = 'buying' THEN '. A key requirement is: ' || hard[1] || '.' WHEN scenario_type = 'intent_override' THEN '. ' || soft[-1] ELSE ', but I''m still exploring.' END AS opener,
  CASE WHEN scenario_type = 'buying' THEN hard[1] WHEN scenario_type = 'intent_override' THEN rtrim(soft[-1], '.') END AS stated FROM sessions),
openers AS (SELECT DISTINCT opener, stated FROM opened)"""
CATEGORY = f""",
cstats AS (SELECT category, count(*) AS n_items, row_number() OVER (ORDER BY category) - 1 AS cat_idx, ln(count(*) / sum(count(*)) OVER ()) AS log_prior, count(*) OVER () AS n_categories, {stems('category')} AS stems FROM items GROUP BY category),
cterms AS (SELECT category, len(stems) AS n_stems, unnest(stems) AS term FROM cstats),
idf AS (SELECT term, ln((SELECT count(*) FROM cstats) / count(*)) AS idf FROM cterms GROUP BY term),
oterms AS (SELECT opener, unnest({stems('opener')}) AS term FROM (SELECT DISTINCT opener FROM openers)),
shared AS (SELECT opener, category, sum(idf) AS w, count(*) AS n, max(n_stems) AS n_stems FROM oterms JOIN cterms USING (term) JOIN idf USING (term) GROUP BY 1, 2),
cscores AS (SELECT opener, category, w * n / n_stems + CASE WHEN contains(lower(opener), lower(category)) THEN 3.0 * w ELSE 0 END AS score FROM shared),
logits AS (SELECT o.opener, c.category, cat_idx, n_items, coalesce(score, -30.0) / 2.0 + 0.25 * log_prior AS logit FROM (SELECT DISTINCT opener FROM openers) o CROSS JOIN cstats c LEFT JOIN cscores s ON s.opener = o.opener AND s.category = c.category),
post AS (SELECT opener, category, cat_idx, n_items, round(exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY opener), 12) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY opener) AS m FROM logits)),
walked AS (SELECT *, coalesce(sum(p) OVER w, 0) AS mass, coalesce(sum(n_items) OVER w, 0) AS before FROM post WINDOW w AS (PARTITION BY opener ORDER BY p DESC, cat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pool AS MATERIALIZED (SELECT opener, parent_asin, (before + spot)::BIGINT AS pool_pos FROM walked JOIN (SELECT category, parent_asin, row_number() OVER (PARTITION BY category ORDER BY cat_pos) - 1 AS spot FROM items) USING (category) WHERE round(mass, 9) < 0.85 AND before < 8000 AND before + spot < 8000),
beliefs AS (SELECT o.opener, stated AS text, parent_asin, pool_pos, CASE WHEN list_contains(card, stated) THEN 1.0 ELSE greatest(0.02, exp(-3.2)) END AS e, list_contains(card, stated) AS hit FROM openers o JOIN pool USING (opener) JOIN items USING (parent_asin) WHERE stated IS NOT NULL),
normed AS (SELECT *, round(e / sum(e) OVER (PARTITION BY opener, text), 9) AS p FROM beliefs),
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opener, text ORDER BY p DESC, pool_pos) AS rank FROM normed) WHERE rank <= 10),
results AS (SELECT sample_id, scenario_type, rank IS NOT NULL AND scenario_type <> 'intent_override' AS hit, CASE WHEN rank IS NOT NULL AND scenario_type <> 'intent_override' THEN 1 END AS first_hit_turn,
  CASE WHEN rank IS NOT NULL AND scenario_type <> 'intent_override' THEN 1.0 / rank ELSE 0.0 END::DOUBLE AS reciprocal_rank FROM opened s LEFT JOIN heads h ON h.opener = s.opener AND h.parent_asin = s.parent_asin)"""
PLAY = f""",
convs AS MATERIALIZED (SELECT row_number() OVER () AS c, * FROM (SELECT DISTINCT scenario_type, CASE WHEN scenario_type = 'intent_override' THEN override_turn ELSE 0 END AS ot, category, opener, stated, hard, soft, card FROM opened)),
member AS (SELECT c, o.sample_id, o.scenario_type, o.override_turn, o.parent_asin FROM opened o JOIN convs v ON v.scenario_type = o.scenario_type AND v.ot = CASE WHEN o.scenario_type = 'intent_override' THEN o.override_turn ELSE 0 END AND v.opener = o.opener AND v.hard = o.hard AND v.soft = o.soft),
play(c, turn, known, message) AS (
  SELECT c, 1, CASE WHEN scenario_type = 'buying' THEN hard[1:1] ELSE CAST([] AS VARCHAR[]) END, opener FROM convs
  UNION ALL
  SELECT c, turn + 1, CASE WHEN here THEN known || hard[1:1] WHEN away THEN known ELSE known || rest END,
    CASE WHEN here THEN 'Actually, ignore my earlier preference. What I need is: ' || hard[1] || '.' WHEN away THEN 'I don''t have a preference for other; please use your judgment.'
      WHEN len(rest) > 0 THEN 'For that, what matters is: ' || array_to_string(rest, '; ') || '.' ELSE 'I don''t have an additional preference for other.' END
  FROM (SELECT p.c, p.turn, p.known, v.hard, list_filter(v.card, lambda x: NOT list_contains(p.known, x))[1:2] AS rest,
      v.scenario_type = 'intent_override' AND v.ot = p.turn + 1 AS here, v.scenario_type = 'boundary' AND p.turn = 1 AS away FROM play p JOIN convs v USING (c) WHERE p.turn < 10)),
heard AS (SELECT c, turn, message, CASE WHEN message LIKE 'I''m looking for %' THEN 'opener' WHEN message LIKE 'Actually, ignore%' THEN 'override' WHEN message LIKE 'For that,%' THEN 'reply' ELSE 'no_preference' END AS kind FROM play),
told AS (SELECT h.c, turn, kind, list_filter(list_transform(CASE kind WHEN 'opener' THEN CASE WHEN stated IS NULL THEN CAST([] AS VARCHAR[]) ELSE [stated] END WHEN 'override' THEN [regexp_extract(message, '(?s)What I need is: (.+?)\\.?$', 1)]
    WHEN 'reply' THEN string_split(regexp_extract(message, '(?s)what matters is: (.+?)\\.?$', 1), '; ') ELSE CAST([] AS VARCHAR[]) END, lambda t: rtrim(trim(t), '.')), lambda t: t <> '') AS texts FROM heard h JOIN convs USING (c)),
parted_texts AS (SELECT c, turn, unnest(texts) AS text, (generate_subscripts(texts, 1) - 1)::INT AS part FROM told),
meaning AS (SELECT text, unnest(ps) AS p, (generate_subscripts(ps, 1) - 1)::INT AS reading FROM (SELECT text, {ordered('ps')} AS ps FROM (SELECT text, {pairs_of('text')} AS ps FROM (SELECT DISTINCT text FROM parted_texts)))),
numbered AS (SELECT c, turn, part, reading, text, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value,
    row_number() OVER (PARTITION BY c, reading = 0, text ORDER BY turn, part, reading) AS nt, row_number() OVER (PARTITION BY c, p ORDER BY turn, part, reading) AS nv FROM parted_texts JOIN meaning USING (text)),
held AS (SELECT c, turn, part, reading, text, attribute, value FROM numbered WHERE CASE WHEN reading = 0 THEN nt = 1 ELSE nv = 1 END),
turned AS (SELECT c, min(turn) AS demoted_turn FROM heard WHERE kind = 'override' GROUP BY 1),
weighed AS MATERIALIZED (SELECT h.*, t::INT AS at_turn, pow(0.9, t - turn) * CASE WHEN turn <= 1 AND demoted_turn <= t THEN 0.35 ELSE 1.0 END AS weight FROM held h LEFT JOIN turned USING (c), range(1, 11) r(t) WHERE t >= turn),
gains AS (SELECT c, turn, (SELECT count(*) FROM held k WHERE k.c = h.c AND k.turn = h.turn) AS gained FROM heard h),
stalled AS (SELECT c, turn, gained, turn - coalesce(max(CASE WHEN gained > 0 THEN turn END) OVER (PARTITION BY c ORDER BY turn), 1) AS stalls FROM gains),
depths AS MATERIALIZED (SELECT s.c, s.turn, stalls, CASE WHEN scenario_type = 'intent_override' AND s.turn < least(3, ot) THEN 0 WHEN s.turn >= 10 THEN 10 ELSE (SELECT max(k) FROM range(1, 11) r(k) WHERE 1.0 / k > greatest(0, 0.75 * pow(0.8, stalls) - 0.0667)) END::INT AS depth,
    s.turn >= 4 OR scenario_type <> 'intent_override' OR s.turn >= ot AS proven FROM stalled s JOIN convs USING (c))"""
FUSE = f""",
said AS (SELECT DISTINCT text, attribute, value FROM held),
said_texts AS (SELECT DISTINCT text FROM said),
pair_of AS (SELECT DISTINCT parent_asin, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT parent_asin, unnest({pairs_of('s')}) AS p FROM (SELECT parent_asin, trim(unnest(spec)) AS s FROM items))),
want_t AS (SELECT text, len(t) AS n, unnest(t) AS token FROM (SELECT text, {tokens('text')} AS t FROM said_texts)),
have_t AS (SELECT parent_asin, unnest({tokens('s')}) AS token FROM (SELECT parent_asin, array_to_string(spec, ' ') || ' ' || title AS s FROM items)),
match_x AS (SELECT DISTINCT text, parent_asin FROM said_texts JOIN (SELECT unnest(card) AS text, parent_asin FROM items) USING (text)),
match_l AS (SELECT text, parent_asin, count(*) / max(n) AS share FROM want_t JOIN have_t USING (token) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.34),
direct AS (SELECT text, attribute, value, parent_asin, max(s) AS s FROM (SELECT text, attribute, value, parent_asin, 1.0::DOUBLE AS s FROM said JOIN match_x USING (text) UNION ALL SELECT text, attribute, value, parent_asin, 1.5 / 3.2 FROM said JOIN pair_of USING (attribute, value)
    UNION ALL SELECT text, attribute, value, parent_asin, share * 0.9 / 3.2 FROM said JOIN match_l USING (text)) GROUP BY 1, 2, 3, 4),
card_t AS (SELECT parent_asin, spot, len(h) AS m, unnest(h) AS token FROM (SELECT parent_asin, spot, {tokens('s')} AS h FROM (SELECT parent_asin, unnest(card) AS s, generate_subscripts(card, 1) AS spot FROM items))),
card_k AS (SELECT text, parent_asin, spot, count(*) AS k, max(n) AS n, max(m) AS m FROM want_t JOIN card_t USING (token) GROUP BY 1, 2, 3),
card_b AS (SELECT text, parent_asin, max(k / (n + m - k)) AS best FROM card_k GROUP BY 1, 2),
soft_b AS (SELECT * FROM card_b b WHERE best >= 0.34 AND NOT EXISTS (SELECT 1 FROM match_x x WHERE x.text = b.text AND x.parent_asin = b.parent_asin)),
gain AS MATERIALIZED (SELECT text, attribute, value, parent_asin, sum(g) AS g FROM (SELECT text, attribute, value, parent_asin, ln(greatest(0.02, exp(3.2 * (s - 1)))) - ln(greatest(0.02, exp(-3.2))) AS g FROM direct
    UNION ALL SELECT text, attribute, value, parent_asin, 1.5 * best FROM said JOIN soft_b USING (text)) GROUP BY 1, 2, 3, 4),
scored AS (SELECT c, at_turn, parent_asin, sum(weight * g) AS e FROM weighed JOIN gain USING (text, attribute, value) GROUP BY 1, 2, 3),
placed AS (SELECT v.c, t::INT AS turn, p.parent_asin, p.pool_pos, coalesce(round(e, 9), 0) AS e FROM convs v JOIN pool p USING (opener) CROSS JOIN range(1, 11) r(t) LEFT JOIN scored s ON s.c = v.c AND s.at_turn = t AND s.parent_asin = p.parent_asin),
tops AS (SELECT c, turn, list(pool_pos ORDER BY e DESC, pool_pos) AS head, max(n_pool) AS n_pool FROM (SELECT *, row_number() OVER (PARTITION BY c, turn ORDER BY e DESC, pool_pos) AS rank, count(*) OVER (PARTITION BY c, turn) AS n_pool FROM placed) WHERE rank <= 100 GROUP BY 1, 2),
steps AS MATERIALIZED (SELECT * FROM tops JOIN depths USING (c, turn)),
lists(c, turn, gone, shipped, own) AS (
  SELECT c, 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT c FROM steps)
  UNION ALL
  SELECT c, turn, CASE WHEN proven THEN list_distinct(gone || ranked[1:depth]) ELSE gone END, ranked[1:depth], ranked[1:10] FROM (
    SELECT s.c, s.turn, l.gone, s.proven, s.depth, CASE WHEN len(l.gone) < s.n_pool THEN list_filter(s.head, lambda x: NOT list_contains(l.gone, x)) || CASE WHEN s.turn = 10 THEN list_sort(l.gone) ELSE CAST([] AS BIGINT[]) END ELSE s.head END AS ranked
    FROM lists l JOIN steps s ON s.c = l.c AND s.turn = l.turn + 1)),
named AS (SELECT c, turn, list(parent_asin ORDER BY spot) AS names FROM (SELECT c, turn, unnest(shipped) AS pool_pos, generate_subscripts(shipped, 1) AS spot FROM lists) JOIN convs USING (c) JOIN pool USING (opener, pool_pos) GROUP BY 1, 2),
shown AS (SELECT c, turn, coalesce(names, CAST([] AS VARCHAR[])) AS shipped FROM lists LEFT JOIN named USING (c, turn) WHERE turn > 0),
outcome AS (SELECT sample_id, scenario_type, min(CASE WHEN list_contains(shipped, parent_asin) AND (scenario_type <> 'intent_override' OR turn >= override_turn) THEN turn * 100 + list_position(shipped, parent_asin) END) AS f FROM member JOIN shown USING (c) GROUP BY 1, 2),
played AS (SELECT sample_id, scenario_type, f IS NOT NULL AS hit, (f // 100)::INT AS first_hit_turn, coalesce(1.0 / (f % 100), 0.0)::DOUBLE AS reciprocal_rank FROM outcome)"""
SPLIT = """,
firsts AS (SELECT target_pos, arg_min(scenario_type, sample_id) AS stratum FROM samples GROUP BY 1),
parted AS (SELECT target_pos, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(target_pos::VARCHAR), target_pos) <= round(count(*) OVER (PARTITION BY stratum) * 0.4) THEN 'test' ELSE 'train' END AS part FROM firsts)"""


def over(prelude: str, body: str) -> str:
    return f"WITH RECURSIVE {prelude.lstrip().removeprefix(',')} {body}"


ITEMS, SESSIONS, BELIEF = CATALOG, CATALOG + SAMPLES, CATALOG + SAMPLES + CATEGORY
VOCABULARY = f""",
label_pairs AS (SELECT label, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT label, unnest({ordered('ps')}) AS p FROM (SELECT text AS label, {pairs_of('trim(text)')} AS ps FROM card_texts))),
label_concepts AS MATERIALIZED (SELECT label, attribute, concept FROM {concept_of('label_pairs')}),
concepts AS MATERIALIZED (SELECT attribute, concept, label, parent_asin, cat_pos FROM (SELECT parent_asin, cat_pos, unnest(card) AS label FROM items) JOIN label_concepts USING (label)),
labels AS (SELECT attribute, concept, label, count(*) AS n FROM concepts GROUP BY 1, 2, 3),
chosen AS (SELECT attribute, concept, label, count(*) OVER (PARTITION BY attribute, concept) AS n_labels, row_number() OVER (PARTITION BY attribute, concept ORDER BY {folded('label')} = concept DESC, n DESC, length(label), label DESC) AS r FROM labels),
reps AS (SELECT attribute, concept, label, n_labels FROM chosen WHERE r = 1),
phrases AS (SELECT DISTINCT split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS phrase FROM (SELECT unnest({pairs_of('s')}) AS p FROM (SELECT trim(unnest(spec)) AS s FROM items))),
literals AS (SELECT attribute, label, {folded('label')} AS k, row_number() OVER (PARTITION BY attribute, {folded('label')} ORDER BY n DESC, spot, label DESC) AS r FROM (SELECT attribute, label, count(*) AS n, min(cat_pos) AS spot FROM concepts GROUP BY 1, 2))"""
RESOLVE = f""",
titles AS (SELECT DISTINCT title AS phrase FROM items WHERE trim(title) <> ''),
tterms AS (SELECT phrase, unnest({stems('phrase')}) AS term FROM titles),
tshared AS (SELECT phrase, category, sum(idf) AS w, count(*) AS n, max(n_stems) AS n_stems FROM tterms JOIN cterms USING (term) JOIN idf USING (term) GROUP BY 1, 2),
tlogits AS (SELECT phrase, s.category, cat_idx, round((w * n / s.n_stems + CASE WHEN contains(lower(phrase), lower(s.category)) THEN 3.0 * w ELSE 0 END) / 2.0 + 0.25 * log_prior, 9) AS logit FROM tshared s JOIN cstats USING (category)),
tranked AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY logit DESC, cat_idx) AS rank FROM tlogits),
texact AS (SELECT phrase, min(category) AS category FROM titles JOIN cstats ON lower(category) = lower(trim(phrase)) GROUP BY 1),
hypotheses AS (SELECT phrase, 1::BIGINT AS rank, category, 1.0::DOUBLE AS p FROM texact UNION ALL SELECT phrase, rank, category, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY phrase) FROM (SELECT *, max(logit) OVER (PARTITION BY phrase) AS m FROM tranked WHERE rank <= 12) WHERE phrase NOT IN (SELECT phrase FROM texact))"""
TURNS, PLAYED = SESSIONS + PLAY, BELIEF + PLAY + FUSE
METRICS = (
    "SELECT *, round(greatest(0, least(1, (11 - mttc) / 10)), 6) AS efficiency, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * round(greatest(0, least(1, (11 - mttc) / 10)), 6), 6) AS score FROM (SELECT coalesce(scenario_type, 'all') AS scenario_type, "
    "count(*) AS sample_count, round(avg(hit::INT), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM {} GROUP BY ROLLUP (scenario_type))"
)
PAIRS = f"SELECT DISTINCT parent_asin, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT parent_asin, unnest({pairs_of('s')}) AS p FROM (SELECT parent_asin, trim(unnest(spec)) AS s FROM items))"
ORACLE: dict[str, str] = {
    "token_sets": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {tokens('text')} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "term_bags": f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms('text')} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "stems": over(ITEMS, f"SELECT parent_asin, array_to_string(list_sort({stems('t')}), ' ') AS stems FROM (SELECT parent_asin, title || ' ' || category AS t FROM items)"),
    "classify_constraint": over(ITEMS, f"SELECT text, {classify('text')} AS attribute FROM card_texts"),
    "clean_value": f"SELECT conv_id, turn, {clean('text')} AS cleaned FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)",
    "catalog_items": over(ITEMS, "SELECT parent_asin, title, store, round(log_pop, 6) AS log_pop, lexical_text, array_to_string(spec, ' | ') AS spec FROM items"),
    "coarse_category": over(ITEMS, "SELECT parent_asin, category FROM items"),
    "intent_card": over(ITEMS, "SELECT parent_asin, array_to_string(hard, ' | ') AS hard, array_to_string(soft, ' | ') AS soft FROM items"),
    "normalise_pairs": over(ITEMS, PAIRS),
    "popularity_fallback": over(ITEMS, "SELECT parent_asin, rating_number FROM items ORDER BY log_pop DESC, cat_pos LIMIT 50"),
    "category_stats": over(BELIEF, "SELECT category, n_items, cat_idx, round(log_prior, 6) AS log_prior, array_to_string(list_sort(stems), ' ') AS stems FROM cstats"),
    "category_scores": over(BELIEF, "SELECT opener, category, round(score, 6) AS score FROM cscores"),
    "category_posterior": over(BELIEF, "SELECT opener, category, round(p, 6) AS p FROM post"),
    "category_pool": over(BELIEF, "SELECT opener, parent_asin, pool_pos FROM pool"),
    "best_category": over(BELIEF, "SELECT opener, category FROM (SELECT *, row_number() OVER (PARTITION BY opener ORDER BY p DESC, cat_idx) AS r FROM post) WHERE r = 1"),
    "category_hypotheses": over(BELIEF + RESOLVE, "SELECT phrase, rank, category, round(p, 6) AS p FROM hypotheses"),
    "category_of_phrase": over(BELIEF + RESOLVE, "SELECT phrase, CASE WHEN round(p1, 9) >= 0.75 OR p2 IS NULL OR round(p1, 9) >= round(3.0 * p2, 9) THEN category END AS category FROM (SELECT phrase, max(CASE WHEN rank = 1 THEN p END) AS p1, max(CASE WHEN rank = 2 THEN p END) AS p2, max(CASE WHEN rank = 1 THEN category END) AS category FROM hypotheses GROUP BY 1)"),
    "concept_labels": over(ITEMS + VOCABULARY, "SELECT attribute, concept, label, n_labels, support FROM reps JOIN (SELECT attribute, concept, count(DISTINCT parent_asin) AS support FROM concepts GROUP BY 1, 2) USING (attribute, concept)"),
    "canonical_phrases": over(ITEMS + VOCABULARY, f"SELECT p.attribute, phrase, coalesce(l.label, CASE WHEN NOT list_contains({arr(voc.AMBIGUOUS)}, p.k) THEN r.label END) AS label FROM (SELECT *, {alias_of('attribute', 'k')} AS meaning FROM (SELECT *, {folded('phrase')} AS k FROM phrases)) p LEFT JOIN literals l ON l.attribute = p.attribute AND l.k = p.k AND l.r = 1 LEFT JOIN reps r ON r.attribute = p.attribute AND r.concept = p.meaning"),
    "concept_support": over(BELIEF + VOCABULARY + f", asked_pairs AS (SELECT opener, split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT opener, unnest({pairs_of('trim(stated)')}) AS p FROM openers WHERE stated IS NOT NULL)), asked AS (SELECT DISTINCT opener, attribute, concept FROM {concept_of('asked_pairs')})",
        "SELECT opener, attribute, concept, coalesce(n_items, 0) AS n_items FROM asked LEFT JOIN (SELECT opener, attribute, concept, count(*) AS n_items FROM asked JOIN (SELECT DISTINCT attribute, concept, parent_asin FROM concepts) USING (attribute, concept) JOIN pool USING (opener, parent_asin) GROUP BY 1, 2, 3) USING (opener, attribute, concept)"),
    "session_samples": over(SESSIONS, "SELECT sample_id, scenario_type, override_turn, parent_asin, category FROM sessions"),
    "initial_messages": over(SESSIONS, "SELECT sample_id, opener AS message FROM opened"),
    "exact_matches": over(ITEMS, "SELECT text, count(*) AS n_items, min(parent_asin) AS first_item FROM (SELECT DISTINCT unnest(card) AS text, parent_asin FROM items) GROUP BY 1"),
    "attribute_matches": over(ITEMS + f", item_pairs AS ({PAIRS}), said AS (SELECT DISTINCT split_part(p, '=', 1) AS attribute, substr(p, position('=' IN p) + 1) AS value FROM (SELECT unnest({pairs_of('text')}) AS p FROM (SELECT trim(text) AS text FROM card_texts)))", "SELECT attribute, value, count(*) AS n_items FROM said JOIN item_pairs USING (attribute, value) GROUP BY 1, 2"),
    "lexical_overlap": over(ITEMS + f", want AS (SELECT text, {tokens('text')} AS t FROM card_texts), have AS (SELECT parent_asin, {tokens('s')} AS h FROM (SELECT parent_asin, array_to_string(spec, ' ') || ' ' || title AS s FROM items)), "
        "wt AS (SELECT text, len(t) AS n, unnest(t) AS token FROM want), ht AS (SELECT parent_asin, unnest(h) AS token FROM have), m AS (SELECT text, parent_asin, count(*) / max(n) AS share FROM wt JOIN ht USING (token) GROUP BY 1, 2)",
        "SELECT text, count(*) AS n_items, round(sum(share), 4) AS total FROM m WHERE share >= 0.34 GROUP BY 1"),
    "softcard_jaccard": over(ITEMS + f", want AS (SELECT text, {tokens('text')} AS t FROM card_texts), ct AS (SELECT parent_asin, card, unnest(card) AS s, generate_subscripts(card, 1) AS spot FROM items), have AS (SELECT parent_asin, spot, {tokens('s')} AS h FROM ct), "
        "wt AS (SELECT text, len(t) AS n, unnest(t) AS token FROM want), ht AS (SELECT parent_asin, spot, len(h) AS m, unnest(h) AS token FROM have), k AS (SELECT text, parent_asin, spot, count(*) AS k, max(n) AS n, max(m) AS m FROM wt JOIN ht USING (token) GROUP BY 1, 2, 3), "
        "b AS (SELECT text, parent_asin, max(k / (n + m - k)) AS best FROM k GROUP BY 1, 2)",
        "SELECT text, count(*) AS n_items, round(sum(best), 4) AS total FROM b WHERE best >= 0.34 AND NOT EXISTS (SELECT 1 FROM items i WHERE i.parent_asin = b.parent_asin AND list_contains(i.card, b.text)) GROUP BY 1"),
    "bm25_scores": f"WITH bags AS (SELECT doc_id, {terms('text')} AS bag FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), sizes AS (SELECT count(*) AS n, avg(greatest(len(bag), 1)) AS al FROM bags), "
        "tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, greatest(len(bag), 1) AS len, unnest(bag) AS term FROM bags) GROUP BY 1, 2, 3), "
        f"want AS (SELECT DISTINCT query_id, unnest({terms('text')}) AS term FROM (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark)), idf AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, sizes GROUP BY term), "
        "qi AS (SELECT query_id, term, idf FROM want JOIN idf USING (term)), ceil AS (SELECT query_id, sum(idf) AS c FROM qi GROUP BY 1), sc AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS s FROM qi JOIN tf USING (term), sizes GROUP BY 1, 2), "
        "st AS (SELECT query_id, doc_id, round(least(1.0, s / c), 6) AS strength FROM sc JOIN ceil USING (query_id)) SELECT query_id, rank, strength FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, doc_id) AS rank FROM st) WHERE rank <= 10",
    "ranked_topk": over(BELIEF, "SELECT opener, text, rank, parent_asin, round(p, 6) AS p FROM heads"),
    "belief_entropy": over(BELIEF, "SELECT opener, text, count(*) AS n, round(CASE WHEN count(*) > 1 THEN -sum(x * ln(x)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT opener, text, e / sum(e) OVER (PARTITION BY opener, text) AS x FROM beliefs) GROUP BY 1, 2"),
    "session_results": over(PLAYED, "SELECT sample_id, scenario_type, f IS NOT NULL AS hit, (f // 100)::INT AS first_hit_turn, (f % 100)::INT AS best_rank, round(coalesce(1.0 / (f % 100), 0.0)::DOUBLE, 6) AS reciprocal_rank FROM outcome"),
    "metrics_rollup": over(BELIEF, METRICS.format("results")),
    "transcripts": over(TURNS, "SELECT sample_id, turn, message FROM member JOIN play USING (c)"),
    "parse_templates": over(TURNS, "SELECT kind, CASE WHEN kind = 'opener' THEN CASE scenario_type WHEN 'buying' THEN 'buying' WHEN 'intent_override' THEN 'override' ELSE 'browsing' END END AS route, count(*) AS n, sum(len(texts))::BIGINT AS n_texts, "
        "count(DISTINCT CASE WHEN kind = 'opener' THEN category END) AS n_categories FROM member m JOIN told USING (c) JOIN (SELECT c, category FROM convs) USING (c) GROUP BY 1, 2"),
    "constraints": over(TURNS, "SELECT sample_id, turn, part, reading, text, attribute, value FROM member JOIN held USING (c)"),
    "constraint_weights": over(TURNS, "SELECT sample_id, at_turn, count(*) AS n_live, round(sum(weight), 6) AS weight FROM member JOIN weighed USING (c) GROUP BY 1, 2"),
    "override_demotion": over(TURNS, "SELECT sample_id, text, attribute, value, demoted_turn FROM member JOIN held USING (c) JOIN turned USING (c) WHERE turn <= 1"),
    "stall_counter": over(TURNS, "SELECT sample_id, turn, gained, stalls FROM member JOIN stalled USING (c)"),
    "list_depths": over(TURNS, "SELECT scenario_type, turn, depth, proven, count(*) AS n_sessions FROM member JOIN depths USING (c) GROUP BY 1, 2, 3, 4"),
    "played_lists": over(PLAYED, "SELECT sample_id, turn, array_to_string(shipped, ' ') AS shipped FROM member JOIN shown USING (c)"),
    "played_results": over(PLAYED, "SELECT sample_id, scenario_type, hit, first_hit_turn, round(reciprocal_rank, 6) AS reciprocal_rank FROM played"),
    "played_metrics": over(PLAYED, METRICS.format("played")),
    "early_hit_curve": over(BELIEF, "SELECT t::INT AS turn, round(avg(CASE WHEN first_hit_turn <= t THEN 1.0 ELSE 0.0 END), 6) AS share FROM results, range(1, 11) r(t) GROUP BY 1"),
    "normalize_recommendations": "SELECT session, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY spot, id) AS rank FROM (SELECT l_orderkey AS session, l_partkey AS id, min(l_linenumber) AS spot FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2)) WHERE rank <= 10",
    "stratified_split": over(SESSIONS + SPLIT, "SELECT sample_id, scenario_type, part FROM samples JOIN parted USING (target_pos)"),
    "split_disjoint": over(SESSIONS + SPLIT, "SELECT count(*) AS n_targets, sum((n > 1)::INT)::BIGINT AS n_shared FROM (SELECT target_pos, count(DISTINCT part) AS n FROM samples JOIN parted USING (target_pos) GROUP BY 1)"),
    "bootstrap_ci": "WITH d AS (SELECT doc_id, quality::DOUBLE AS v, r, ('0x' || left(md5(doc_id || ':' || r), 8))::UBIGINT / 4294967296.0 AS u FROM labels, range(1, 201) t(r)), k AS (SELECT *, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 ELSE 4 END AS k FROM d), m AS (SELECT r, sum(k * v) / sum(k) AS m FROM k GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m",
}

#: All positive scores, where bm25_scores reports the ten best of each item.
ORACLE["bm25_all_scores"] = ORACLE["bm25_scores"].split(" SELECT query_id, rank, strength")[0] + " SELECT query_id, doc_id, strength FROM st"
