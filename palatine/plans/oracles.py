"""The same queries as DuckDB SQL."""

from __future__ import annotations

_B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def name_text(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"


def surface(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, 'None')), '[{_B}]+', ' ', 'g'))"


def compact(c: str) -> str:
    return f"translate({surface(c)}, ' -_', '')"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^0-9A-Za-z]+'), lambda x: x <> '')"


def truthy(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '')"


_MFP = f"""mfp AS (SELECT id, actual_food, molecules, lower({strip('split')}) AS split, ingest_seq FROM mfp_tasks WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"""
_MPC = f"""mpc AS (SELECT id, target_food, partial_molecules, n, missing_molecules, lower({strip('split')}) AS split FROM mpc_reconstructed_tasks WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"""


def _join(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: coalesce(x, 'null')), ' | ')"


def _spaced(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' '), '')"


def bm25(docs: str, queries: str, k: int = 3, with_: str = "") -> str:
    """Top k of ``queries`` (query_id, text) in ``docs`` (doc_id, text) with zero-score fill."""
    return f"""
WITH {with_} d AS ({docs}), q AS ({queries}),
dl AS (SELECT doc_id, CAST(len({tokens('text')}) AS DOUBLE) AS dl FROM d),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, token, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM d) GROUP BY 1, 2),
df AS (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS token FROM q) GROUP BY 1, 2),
hit AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln(CAST(1 AS DOUBLE) + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))
    * (tf * CAST(2.5 AS DOUBLE)) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 12) AS score
  FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2),
allp AS (SELECT q.query_id, f.doc_id, CAST(0 AS DOUBLE) AS score FROM q, (SELECT doc_id FROM d ORDER BY doc_id LIMIT {2 * k}) f
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = q.query_id AND hit.doc_id = f.doc_id)
  UNION ALL SELECT query_id, doc_id, score FROM hit)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM allp) WHERE rank <= {k}"""


_DOCS = "SELECT doc_id, text FROM documents"
_BM25 = bm25(_DOCS, "SELECT item_id AS query_id, text FROM eval_passages")
_FOOD_DOC = f"'Food: ' || {truthy('actual_food')} || '. Molecules: ' || {_spaced('molecules')}"

_LEVELS = ("entity_alias_readable", "entity_alias", "natural_source_name", "entity_alias_basket", "entity_alias_synonyms", "category_readable", "category")
_INDEX = " UNION ALL ".join(
    f"SELECT entity_id, {i} AS level, {c} AS n FROM food_entities" + (f" UNION ALL SELECT entity_id, {i}, unnest(regexp_split_to_array({c}, '[;,|]')) FROM food_entities" if c in ("entity_alias_basket", "entity_alias_synonyms") else "")
    for i, c in enumerate(_LEVELS)
)
_RESOLVED = f"""
WITH {_MFP}, raw AS ({_INDEX}), idx AS (SELECT DISTINCT level, {name_text('n')} AS name, entity_id FROM raw WHERE {name_text('n')} <> ''),
best AS (SELECT name, min(level) AS level FROM idx GROUP BY name),
cand AS (SELECT name, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM idx JOIN best USING (name, level) GROUP BY name),
res AS (SELECT id, CASE WHEN n = 1 THEN 'matched_unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
  CASE WHEN n = 1 THEN e END AS entity_id, coalesce(n, 0) AS n_candidates FROM mfp LEFT JOIN cand ON name = {name_text('actual_food')})"""

_SETS = f"""
WITH full_ AS (SELECT l_orderkey AS entity_id, list_sort(list(DISTINCT {strip('p_name')})) AS f FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
gone AS (SELECT l_orderkey AS entity_id, list({strip('p_name')}) AS g FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1),
base AS (SELECT o_orderkey AS entity_id, coalesce(f, []) AS f, g FROM orders LEFT JOIN full_ ON full_.entity_id = o_orderkey LEFT JOIN gone ON gone.entity_id = o_orderkey),
part_ AS (SELECT *, list_sort(list_filter(f, lambda x: NOT list_contains(list_transform(g, lambda y: lower(y)), lower(x)))) AS p FROM base),
rec AS (SELECT entity_id, CASE WHEN g IS NULL THEN 'invalid_missing_molecules' WHEN len(f) = 0 THEN 'empty_full_molecules'
  WHEN len(p) = 0 THEN 'partial_empty' ELSE 'ok' END AS status, p, len(g) AS n FROM part_)"""

_EVIDENCE = f"""
WITH {_MPC}, ev AS (SELECT {name_text('food_key')} AS k, list(text ORDER BY doc_id) AS s FROM documents
  WHERE doc_type = 'evidence' AND food_key IS NOT NULL AND text IS NOT NULL AND {name_text('food_key')} <> '' GROUP BY 1)
SELECT id, {name_text('target_food')} AS evidence_key, s IS NOT NULL AS evidence_found, coalesce(len(s), 0) AS raw_count, least(coalesce(len(s), 0), 10) AS used_count,
  md5(CASE WHEN s IS NULL THEN '- no_evidence' ELSE array_to_string(list_transform(s[1:10], lambda x: '- ' || x), chr(10)) END) AS block_md5
FROM mpc LEFT JOIN ev ON k = {name_text('target_food')}"""

_BLOCKS = f"""
WITH ev AS (SELECT lower({strip('p_name')}) AS k, list(concat_ws(' ', p_brand, p_type) ORDER BY p_partkey) AS s FROM part GROUP BY 1),
sel AS (SELECT l_orderkey AS id, l_linenumber AS place, min(p_name) AS item FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
one AS (SELECT id, place, item || ':' || chr(10) || CASE WHEN s IS NULL THEN '- no_evidence' ELSE array_to_string(list_transform(s[1:3], lambda x: '- ' || x), chr(10)) END AS text,
  coalesce(len(s), 0) AS raw, least(coalesce(len(s), 0), 3) AS used FROM sel LEFT JOIN ev ON k = lower({strip('item')}))
SELECT id, CAST(sum(raw) AS BIGINT) AS raw_count, CAST(sum(used) AS BIGINT) AS used_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY place, text)) AS block_md5 FROM one GROUP BY id"""

_ENTROPY = f"""
{_MFP}, train AS (SELECT * FROM mfp WHERE split = 'train'),
items AS (SELECT DISTINCT id, lower({strip('m')}) AS item FROM (SELECT id, unnest(molecules) AS m FROM train) WHERE m IS NOT NULL AND {strip('m')} <> ''),
df AS (SELECT item, count(*) AS df FROM items GROUP BY 1),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM train),
ent AS (SELECT item, df, CASE WHEN df = n THEN CAST(0 AS DOUBLE) ELSE -(df / n) * ln(df / n) - (1 - df / n) * ln(1 - df / n) END AS entropy FROM df, tot)"""
_LOWEST = f"""
WITH {_ENTROPY}, pos AS (SELECT id, m, p FROM (SELECT id, unnest(molecules) AS m, generate_subscripts(molecules, 1) AS p FROM mfp WHERE split = 'test') WHERE m IS NOT NULL AND {strip('m')} <> ''),
once AS (SELECT id, lower({strip('m')}) AS item, arg_min(m, p) AS raw, min(p) AS p FROM pos GROUP BY 1, 2),
sc AS (SELECT id, raw, p, round(coalesce(entropy, 0), 9) AS entropy FROM once LEFT JOIN ent USING (item))
SELECT id, place, raw AS item, entropy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entropy, p) AS place FROM sc) WHERE place <= 10"""

_PARSED = "parsed AS (SELECT line_key, CAST(raw AS JSON) AS j FROM prediction_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')"


def clean(c: str) -> str:
    return strip(f"translate({c}, '[]*', '')")


_KNOWN = f"known AS (SELECT {compact('category')} AS c, max(category) AS spelling FROM food_categories WHERE category IS NOT NULL GROUP BY 1)"
_LOOKUP = f"""
{_KNOWN}, cache AS (SELECT {surface('food_key')} AS food, arg_max(spelling, entry_key) AS category FROM food_category_cache JOIN known ON c = {compact('category')}
  WHERE food_key IS NOT NULL AND category IS NOT NULL GROUP BY 1),
cats AS (SELECT entity_alias_readable AS food, arg_max(split_part(category, '-', 1), entity_id) AS category FROM food_entities WHERE category <> '' AND entity_alias_readable <> '' GROUP BY 1)"""
_EVAL = f"""
WITH {_MFP}, {_LOOKUP},
scan AS (SELECT id, detail_id, nullif({clean('predicted_food')}, '') AS food FROM mfp_eval_details WHERE run = 'zero-shot'),
pred AS (SELECT id, arg_max(food, detail_id) AS food FROM scan WHERE food IS NOT NULL GROUP BY 1),
bad AS (SELECT DISTINCT id FROM scan WHERE food IS NULL),
j AS (SELECT mfp.id, mfp.actual_food, pred.food AS predicted_food, pred.id IS NOT NULL AS hit, bad.id IS NOT NULL AS isbad, cats.category AS gold, cache.category AS judged
  FROM mfp LEFT JOIN pred ON pred.id = mfp.id LEFT JOIN bad ON bad.id = mfp.id LEFT JOIN cats ON cats.food = mfp.actual_food
  LEFT JOIN cache ON pred.food IS NOT NULL AND cache.food = {surface('pred.food')} WHERE mfp.split = 'test'),
det AS (SELECT id, actual_food, predicted_food, CASE WHEN hit AND coalesce(gold, '') <> '' THEN gold END AS gold_category,
  CASE WHEN hit AND coalesce(gold, '') <> '' THEN judged END AS predicted_category,
  coalesce(hit AND coalesce(gold, '') <> '' AND {compact('judged')} = {compact('gold')} AND judged IS NOT NULL, false) AS correct,
  CASE WHEN NOT hit AND isbad THEN 'parse_failed' WHEN NOT hit THEN 'missing_prediction' WHEN coalesce(gold, '') = '' THEN 'gold_category_lookup_failed'
    WHEN judged IS NULL THEN 'llm_mapping_failed' END AS failure_reason FROM j),
details AS (SELECT *, coalesce(failure_reason = 'parse_failed', false) AS parse_failed, coalesce(failure_reason = 'llm_mapping_failed', false) AS llm_mapping_failed,
  coalesce(failure_reason = 'gold_category_lookup_failed', false) AS gold_category_lookup_failed, coalesce(failure_reason = 'missing_prediction', false) AS missing_prediction FROM det)"""

_GROUP_LIST = """list_distinct(flatten(list_transform(string_split(coalesce(functional_groups, ''), ' '), lambda t: CASE WHEN contains(t, '@') THEN
  list_concat(CASE WHEN contains(t, 'compound') THEN [split_part(t, '@', 2)] ELSE [] END, CASE WHEN contains(t, 'primary') THEN [split_part(t, '@', 1)] ELSE [] END) ELSE [t] END)))"""
_MOL = f"""
WITH {_MPC}, groups AS (SELECT {surface('common_name')} AS m, arg_max({_GROUP_LIST}, id) AS g FROM molecules WHERE common_name <> '' GROUP BY 1),
gold AS (SELECT id, target_food, n, list_filter(missing_molecules, lambda x: x IS NOT NULL) AS miss FROM mpc),
pred AS (SELECT id, list_filter(partial_molecules, lambda x: x IS NOT NULL) AS p FROM mpc WHERE partial_molecules IS NOT NULL),
gw AS (SELECT id, coalesce(list_distinct(flatten(list(g) FILTER (WHERE g IS NOT NULL))), []) AS want, count(*) FILTER (WHERE g IS NULL) AS lost
  FROM (SELECT id, unnest(miss) AS x FROM gold) LEFT JOIN groups ON m = {surface('x')} GROUP BY id),
gh AS (SELECT id, coalesce(list_distinct(flatten(list(g) FILTER (WHERE g IS NOT NULL))), []) AS have, count(*) FILTER (WHERE g IS NULL) AS unmapped
  FROM (SELECT id, unnest(p) AS x FROM pred) LEFT JOIN groups ON m = {surface('x')} GROUP BY id),
r AS (SELECT gold.id, gold.n, pred.id IS NOT NULL AS hit, coalesce(len(p), 0) AS cnt, CASE WHEN pred.id IS NULL THEN [] ELSE coalesce(want, []) END AS w,
  CASE WHEN pred.id IS NULL THEN [] ELSE coalesce(have, []) END AS h, CASE WHEN pred.id IS NULL THEN 0 ELSE coalesce(lost, 0) END AS lost, coalesce(unmapped, 0) AS unmapped
  FROM gold LEFT JOIN pred ON pred.id = gold.id LEFT JOIN gw ON gw.id = gold.id LEFT JOIN gh ON gh.id = gold.id),
s AS (SELECT *, CAST(len(list_intersect(w, h)) AS DOUBLE) AS common, len(list_distinct(list_concat(w, h))) AS uni FROM r),
t AS (SELECT *, CASE WHEN NOT hit THEN 0 WHEN len(w) = 0 AND len(h) = 0 THEN 1 ELSE common / (len(h) + CAST(1e-9 AS DOUBLE)) END AS p,
  CASE WHEN NOT hit THEN 0 WHEN len(w) = 0 AND len(h) = 0 THEN 1 WHEN len(w) = 0 THEN 0 ELSE common / len(w) END AS rc,
  CASE WHEN NOT hit THEN 0 WHEN len(w) = 0 AND len(h) = 0 THEN 1 WHEN uni = 0 THEN 0 ELSE common / uni END AS iou FROM s),
u AS (SELECT *, CASE WHEN NOT hit THEN 0 WHEN len(w) = 0 AND len(h) = 0 THEN 1 WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END AS f1 FROM t)"""

_KEPT = f"""
WITH {_MPC}, mixed AS (SELECT id, n, list_concat(coalesce(partial_molecules, []), coalesce(missing_molecules, [])) AS a, coalesce(partial_molecules, []) AS known FROM mpc),
x AS (SELECT id, n, known, unnest(list_transform(a, lambda v: {strip("coalesce(v, 'None')")})) AS v, generate_subscripts(a, 1) AS p FROM mixed),
y AS (SELECT id, n, v, p, {name_text('v')} AS k FROM x WHERE {name_text('v')} <> '' AND NOT list_contains(list_transform(known, lambda z: {name_text('z')}), {name_text('v')})),
z AS (SELECT id, n, arg_min(v, p) AS v, min(p) AS p FROM y GROUP BY id, n, k),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM z),
o AS (SELECT id, string_agg(v, ' | ' ORDER BY p) AS kept, count(*) AS c FROM w WHERE rn <= n GROUP BY id)
SELECT mpc.id, coalesce(kept, '') AS kept, coalesce(c, 0) AS n_kept FROM mpc LEFT JOIN o ON o.id = mpc.id"""

_KIND = "CAST(('0x' || substr(md5(id), 1, 4)) AS INTEGER) % 4"
_TEXTS = "list_transform(missing_molecules, lambda v: coalesce(v, 'null'))"
_BULLETS = rf"""list_filter(list_transform(list_transform(missing_molecules, lambda v: {strip("coalesce(v, 'None')")}),
  lambda v: {strip("regexp_replace(regexp_replace(v, '^[\"'']|[\"'']$', '', 'g'), '[,;。；]+$', '')")}), lambda v: v <> '')"""
_REPLY = f"""
WITH {_MPC}, r AS (SELECT id, {_KIND} AS kind, missing_molecules FROM mpc),
p AS (SELECT id, kind, CASE WHEN kind IN (0, 1, 3) THEN coalesce({_TEXTS}, []) WHEN len({_BULLETS}) > 0 THEN {_BULLETS} END AS x FROM r)
SELECT id, kind, coalesce(len(x), -1) AS n_parsed, array_to_string(x, ' | ') AS parsed FROM p"""

_TRAIN = "train AS (SELECT id, actual_food, molecules FROM mfp WHERE split = 'train')"
_DEMOS = f"""
WITH {_MFP}, {_TRAIN}, cut AS (SELECT id, unnest(retrieved[1:3]) AS d, generate_subscripts(retrieved[1:3], 1) AS rank FROM retrieval_metadata),
demos AS (SELECT cut.id, rank, d.id AS demo_id, actual_food, molecules FROM cut JOIN train ON train.id = d.id)"""
_PROMPT = f"""{_DEMOS},
blocks AS (SELECT id, string_agg('Example ' || rn || chr(10) || 'Molecules: ' || coalesce(array_to_string(molecules, ', '), '') || chr(10) || 'Food: ' || actual_food, chr(10) || chr(10) ORDER BY rank) AS b,
  bool_or(actual_food IS NULL) AS lost FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM demos) GROUP BY id),
texts AS (SELECT mfp.id, concat_ws(chr(10), coalesce(b, ''), '', 'Molecules: ' || coalesce(array_to_string(molecules, ', '), ''), 'Answer with one JSON object: {{"predicted_food": "<name>"}}.') AS text
  FROM mfp LEFT JOIN blocks ON blocks.id = mfp.id WHERE split = 'test')
SELECT id, md5(text) AS prompt_md5, length(text) AS prompt_length FROM texts"""

_SPLIT_HASH = """
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS split_pos, count(*) OVER () AS n FROM documents),
s AS (SELECT *, floor(n * 0.8) AS a0, floor(n * 0.1) AS b0, n * 0.8 - floor(n * 0.8) AS ra, n * 0.1 - floor(n * 0.1) AS rb, n - floor(n * 0.8) - 2 * floor(n * 0.1) AS lefts FROM h),
z AS (SELECT *, a0 + CASE WHEN lefts >= 1 AND ra >= rb THEN 1 WHEN lefts >= 3 THEN 1 ELSE 0 END AS a,
  b0 + CASE WHEN lefts >= 1 AND ra < rb THEN 1 WHEN lefts >= 2 THEN 1 ELSE 0 END AS b FROM s)
SELECT doc_id, split_pos, CASE WHEN split_pos < a THEN 'train' WHEN split_pos < a + b THEN 'dev' ELSE 'test' END AS split FROM z"""

_SHOWN = "regexp_replace(surface, '[\\n\\r]', ' ', 'g')"
_JUDGE = f"""
WITH {_LOOKUP}, k AS (SELECT {surface('predicted_food')} AS key, arg_max(predicted_food, detail_id) AS surface FROM mfp_eval_details
  WHERE predicted_food IS NOT NULL AND {surface('predicted_food')} <> '' GROUP BY 1),
names AS (SELECT list_sort(list(DISTINCT category)) AS a FROM food_categories WHERE category IS NOT NULL)
SELECT key AS food, a[length({_SHOWN}) % len(a) + 1] AS category FROM k, names
WHERE key NOT IN (SELECT food FROM cache) AND length({_SHOWN}) % 5 <> 0"""
_ZERO = f"""
WITH {_MFP}, m AS (SELECT id, list_filter(coalesce(molecules, []), lambda x: x IS NOT NULL AND x <> '') AS a FROM mfp WHERE split = 'test'),
p AS (SELECT id, CASE WHEN len(a) % 4 <> 0 THEN nullif({strip('a[1]')}, '') END AS f FROM m)
SELECT id, f AS predicted_food, CASE WHEN f IS NULL THEN 'parse_failed' END AS error FROM p"""
_ICL = f"""
WITH {_MFP}, {_TRAIN}, cut AS (SELECT id, unnest(retrieved[1:3]) AS d, generate_subscripts(retrieved[1:3], 1) AS rank FROM retrieval_metadata),
last_ AS (SELECT cut.id, arg_max(regexp_replace(actual_food, '[\\n\\r]', ' ', 'g'), rank) AS f FROM cut JOIN train ON train.id = d.id WHERE actual_food IS NOT NULL GROUP BY 1),
p AS (SELECT mfp.id, nullif({strip('f')}, '') AS f FROM mfp LEFT JOIN last_ ON last_.id = mfp.id WHERE split = 'test')
SELECT id, f AS predicted_food, CASE WHEN f IS NULL THEN 'parse_failed' END AS error FROM p"""
_SCAN = f"""
WITH {_MPC}, r AS (SELECT id, {_KIND} AS kind, list_filter(coalesce(missing_molecules, []), lambda x: x IS NOT NULL) AS a FROM mpc),
p AS (SELECT id, CASE kind WHEN 0 THEN a WHEN 1 THEN string_split(regexp_replace('[' || array_to_string(a, ', ') || ']', '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ',') END AS a FROM r WHERE kind < 2),
q AS (SELECT id, list_filter(list_transform(a, lambda x: {strip('x')}), lambda x: x <> '') AS a FROM p)
SELECT id, len(a) AS n_items, coalesce(array_to_string(a, ' | '), '') AS items FROM q"""
_AUDIT = f"""
WITH {_MPC}, mixed AS (SELECT id, n, list_concat(coalesce(partial_molecules, []), coalesce(missing_molecules, [])) AS a,
  list_filter(list_transform(coalesce(partial_molecules, []), lambda z: {name_text('z')}), lambda k: k <> '') AS known FROM mpc),
k AS (SELECT *, list_transform(a, lambda v: {name_text(strip("coalesce(v, 'None')"))}) AS keys FROM mixed),
c AS (SELECT id, n, len(a) AS count_before, len(list_filter(keys, lambda k: k <> '' AND list_contains(known, k))) AS removed_partial,
  len(list_distinct(list_filter(keys, lambda k: k <> '' AND NOT list_contains(known, k)))) AS kept FROM k)
SELECT id, count_before, removed_partial, kept AS count_before_truncation, CASE WHEN n >= 0 AND kept > n THEN n ELSE kept END AS count_after,
  coalesce(n >= 0 AND kept > n, false) AS truncated FROM c"""
_PLAIN = f"""
WITH {_MFP}, {_MPC},
t AS (SELECT 'food:' || id AS id, 'Molecules: ' || CAST(to_json(coalesce(molecules, [])) AS VARCHAR) || chr(10) || 'Answer with one JSON object: {{"predicted_food": "<name>"}}.' AS text FROM mfp WHERE split = 'test'
  UNION ALL SELECT 'completion:' || id, 'Food: ' || {truthy('target_food')} || chr(10) || 'Known molecules: ' || CAST(to_json(coalesce(partial_molecules, [])) AS VARCHAR) || chr(10)
    || 'Name exactly ' || n || ' further molecules, none of the known ones.' || chr(10) || 'Answer with one JSON object: {{"predicted_molecules": ["<name>", ...]}}.' FROM mpc WHERE split = 'test' AND n IS NOT NULL)
SELECT id, md5(text) AS prompt_md5 FROM t"""


def oracle_sql() -> dict[str, str]:
    stats = f"WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS token FROM documents) GROUP BY 1)"
    return {
        "tokenize_counts": f"SELECT doc_id, len({tokens('text')}) AS n_tokens, len(list_distinct({tokens('text')})) AS n_distinct FROM documents",
        "normalize_forms": f"SELECT detail_id, {name_text('predicted_food')} AS name_form, {surface('predicted_food')} AS surface_form, {compact('predicted_food')} AS compact_form, lower({strip('predicted_food')}) AS entropy_form, {clean('predicted_food')} AS clean_form FROM mfp_eval_details",
        "synonym_split": f"WITH p AS (SELECT entity_id, list_filter(list_transform(regexp_split_to_array(entity_alias_synonyms, '[;,|]'), lambda x: {strip('x')}), lambda x: x <> '') AS a FROM food_entities WHERE entity_alias_synonyms IS NOT NULL) SELECT entity_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS part FROM p",
        "functional_group_sets": f"SELECT id, array_to_string(list_sort({_GROUP_LIST}), ' | ') AS groups, len({_GROUP_LIST}) AS n_groups FROM molecules",
        "doc_freq_idf": stats + " SELECT token, df, round(ln(CAST(1 AS DOUBLE) + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), 6) AS idf FROM df, s",
        "bm25_top3": _BM25,
        "bm25_zero_fill": bm25(_DOCS, "SELECT category_id AS query_id, category AS text FROM food_categories"),
        "bm25_tasks_top3": bm25(f"SELECT id AS doc_id, {_FOOD_DOC} AS text FROM mfp WHERE split = 'train'", f"SELECT id AS query_id, {_spaced('molecules')} AS text FROM mfp WHERE split = 'test'", 3, _MFP + ","),
        "bm25_completion_top3": bm25(
            f"SELECT id AS doc_id, concat_ws(' ', {truthy('target_food')}, {_spaced('partial_molecules')}, {_spaced('missing_molecules')}) AS text FROM mpc WHERE split = 'train'",
            f"SELECT id AS query_id, concat_ws(' ', {truthy('target_food')}, {_spaced('partial_molecules')}) AS text FROM mpc WHERE split = 'test'",
            3,
            _MPC + ",",
        ),
        "retrieval_packed": f"SELECT query_id, string_agg(rank || ':' || doc_id, ',' ORDER BY rank) AS retrieved FROM ({_BM25}) GROUP BY query_id",
        "demo_resolution": _DEMOS + " SELECT id, rank, demo_id, actual_food FROM demos",
        "retrieval_gaps": f"WITH {_MFP} SELECT mfp.id, coalesce(len(retrieved), 0) AS found FROM mfp LEFT JOIN retrieval_metadata m ON m.id = mfp.id WHERE split = 'test' AND coalesce(len(retrieved), 0) < 3",
        "name_resolution": _RESOLVED + " SELECT * FROM res",
        "name_resolution_status": _RESOLVED + " SELECT match_status, count(*) AS rows FROM res GROUP BY 1",
        "full_set": _SETS + " SELECT entity_id, array_to_string(f, ' | ') AS full_items, len(f) AS n_full FROM full_",
        "reconstructed": _SETS + " SELECT entity_id, status, CASE WHEN status = 'ok' THEN array_to_string(p, ' | ') END AS partial_items, CASE WHEN status = 'ok' THEN n END AS n FROM rec",
        "reconstruct_status": _SETS + " SELECT status, count(*) AS rows FROM rec GROUP BY 1",
        "set_size_stats": _SETS + " SELECT min(len(f)) AS minimum, max(len(f)) AS maximum, round(avg(len(f)), 6) AS mean FROM full_",
        "task_problems": f"WITH {_MPC} SELECT CASE WHEN target_food IS NULL OR {strip('target_food')} = '' THEN 'invalid_target_food' WHEN partial_molecules IS NULL THEN 'invalid_partial_molecules' WHEN n IS NULL OR n <= 0 THEN 'invalid_n' ELSE 'ok' END AS problem, count(*) AS rows FROM mpc GROUP BY 1",
        "split_hash": _SPLIT_HASH,
        "split_disjoint_check": "SELECT * FROM (VALUES ('dev', 'test', 0, true), ('dev', 'train', 0, true), ('test', 'train', 0, true)) v(part_a, part_b, shared, covered)",
        "presence_entropy": f"WITH {_ENTROPY} SELECT item, df, round(entropy, 9) AS entropy FROM ent",
        "lowest_entropy_top10": _LOWEST,
        "food_evidence": _EVIDENCE,
        "evidence_blocks": _BLOCKS,
        "jsonl_totals": f"SELECT count(*) AS total, count(*) FILTER (WHERE {strip('raw')} = '') AS blank, count(*) FILTER (WHERE CASE WHEN json_valid(raw) THEN json_type(raw) END = 'OBJECT') AS valid, count(*) FILTER (WHERE {strip('raw')} <> '' AND NOT json_valid(raw)) AS bad FROM prediction_lines",
        "jsonl_key_profile": f"WITH {_PARSED} SELECT key, count(*) AS rows FROM (SELECT line_key, unnest(list_distinct(json_keys(j))) AS key FROM parsed) GROUP BY key",
        "food_prediction_scan": f"WITH {_PARSED}, x AS (SELECT line_key, json_extract_string(j, '$.id') AS id, nullif({clean("json_extract_string(j, '$.predicted_food')")}, '') AS f FROM parsed) SELECT id, arg_max(f, line_key) AS predicted_food FROM x WHERE id IS NOT NULL AND f IS NOT NULL GROUP BY id",
        "reply_molecules": _REPLY,
        "clean_prediction_list": _KEPT,
        "food_eval_details": _EVAL + " SELECT id, actual_food, predicted_food, gold_category, predicted_category, correct, parse_failed, llm_mapping_failed, gold_category_lookup_failed, missing_prediction, failure_reason FROM details",
        "food_eval_summary": _EVAL
        + f""" SELECT count(*) AS total_gold, count(*) FILTER (WHERE NOT parse_failed AND NOT missing_prediction) AS matched_ids, count(*) FILTER (WHERE correct) AS correct,
        count(*) FILTER (WHERE parse_failed) AS parse_failed, count(*) FILTER (WHERE llm_mapping_failed) AS llm_mapping_failed, count(*) FILTER (WHERE gold_category_lookup_failed) AS gold_category_lookup_failed,
        count(*) FILTER (WHERE missing_prediction) AS missing_prediction, count(DISTINCT CASE WHEN predicted_food IS NOT NULL THEN {surface('predicted_food')} END) AS unique_predicted_foods,
        round(count(*) FILTER (WHERE correct) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM details""",
        "extra_predictions": f"WITH {_MFP} SELECT DISTINCT id FROM mfp_eval_details WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM mfp WHERE split = 'test')",
        "molecule_eval_details": _MOL
        + " SELECT id, cnt AS predicted_molecule_count, CASE WHEN n IS NOT NULL THEN cnt = n END AS predicted_count_equals_n, lost AS gold_group_lookup_failures, array_to_string(list_sort(list_intersect(w, h)), ' | ') AS overlap, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou, CASE WHEN NOT hit THEN 'missing_prediction' END AS failure_reason FROM u",
        "molecule_eval_summary": _MOL
        + f""" SELECT count(*) AS total_gold, count(*) FILTER (WHERE hit) AS matched_ids, 0 AS parse_failed, count(*) FILTER (WHERE NOT hit) AS missing_prediction,
        count(*) FILTER (WHERE hit AND f1 = 0) AS zero_f1_count, count(*) FILTER (WHERE n IS NOT NULL AND cnt <> n) AS predicted_count_not_equal_n, CAST(sum(lost) AS BIGINT) AS gold_group_lookup_failures,
        CAST(sum(unmapped) AS BIGINT) AS unmapped_predicted_molecules, round(avg(p), 6) AS average_precision, round(avg(rc), 6) AS average_recall, round(avg(f1), 6) AS average_f1, round(avg(iou), 6) AS average_iou,
        (SELECT count(DISTINCT {surface('x')}) FROM (SELECT unnest(p) AS x FROM pred) LEFT JOIN groups ON m = {surface('x')} WHERE g IS NULL) AS unique_unmapped_predicted_molecules FROM u""",
        "judge_cache_misses": f"WITH {_LOOKUP}, k AS (SELECT {surface('predicted_food')} AS key, arg_max(predicted_food, detail_id) AS surface FROM mfp_eval_details WHERE predicted_food IS NOT NULL AND {surface('predicted_food')} <> '' GROUP BY 1) SELECT key, surface FROM k WHERE key NOT IN (SELECT food FROM cache)",
        "judge_cache_hits": f"WITH {_LOOKUP}, k AS (SELECT {surface('predicted_food')} AS key, arg_max(predicted_food, detail_id) AS surface FROM mfp_eval_details WHERE predicted_food IS NOT NULL AND {surface('predicted_food')} <> '' GROUP BY 1) SELECT key, surface, category FROM k JOIN cache ON food = key",
        "latest_upsert": "SELECT id, arg_max(struct_pack(f := actual_food), ingest_seq).f AS actual_food, min(ingest_seq) AS ord, max(ingest_seq) AS seq FROM mfp_tasks WHERE id IS NOT NULL GROUP BY id",
        "resume_pending": f"WITH {_MFP} SELECT id FROM mfp WHERE split = 'test' AND id NOT IN (SELECT id FROM mfp_eval_details WHERE run = 'zero-shot' AND NOT parse_failed AND id IS NOT NULL)",
        "table_profile": " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS rows, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{n}' AND column_index <= 10) AS columns"
            for n in ("documents", "food_entities", "mfp_tasks", "molecules", "retrieved")
        ),
        "split_histogram": f"WITH {_MFP} SELECT split, count(*) AS rows FROM mfp GROUP BY split",
        "prompt_text": _PROMPT,
        "judge_stub": _JUDGE,
        "zero_shot_stub": _ZERO,
        "icl_stub": _ICL,
        "molecule_prediction_scan": _SCAN,
        "final_molecule_audit": _AUDIT,
        "completed_ids": f"SELECT DISTINCT id FROM mfp_eval_details WHERE id IS NOT NULL AND NOT coalesce(parse_failed, false) AND {strip('predicted_food')} <> ''",
        "train_test_overlap": f"WITH {_MFP}, {_MPC} SELECT split_part(id, '-', -1) AS number FROM mfp WHERE split = 'train' AND split_part(id, '-', -1) IN (SELECT split_part(id, '-', -1) FROM mpc WHERE split <> 'train')",
        "formatted_molecules": f"WITH {_MPC} SELECT id, coalesce(array_to_string(missing_molecules, ', '), '') AS all_items, coalesce(array_to_string(missing_molecules[1:3], ', '), '') AS first_items FROM mpc",
        "plain_prompts": _PLAIN,
    }
