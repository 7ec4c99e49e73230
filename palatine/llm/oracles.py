"""The same queries as DuckDB SQL, written plainly and without the operators' methods."""

from __future__ import annotations

NAME = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
VALUE = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_CURRENT = """
mfp AS (SELECT * FROM mfp_tasks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1),
mpc AS (SELECT * FROM mpc_reconstructed_tasks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"""

_FOODS = f"""
parts AS (
  SELECT entity_id, entity_alias_readable AS n FROM food_entities
  UNION ALL
  SELECT entity_id, unnest(regexp_split_to_array(entity_alias_synonyms, '[;,|]')) AS n FROM food_entities),
foods AS (
  SELECT {NAME.format("n")} AS food_name, min(entity_id) AS entity_id FROM parts
  WHERE n IS NOT NULL AND {NAME.format("n")} <> '' GROUP BY 1)"""

_P1 = f"""
WITH {_CURRENT},
raw AS (
  SELECT id, unnest(molecules) AS v FROM mfp
  UNION ALL SELECT id, unnest(partial_molecules) FROM mpc
  UNION ALL SELECT id, unnest(missing_molecules) FROM mpc),
sets AS (SELECT DISTINCT id, {VALUE.format("v")} AS v FROM raw WHERE v IS NOT NULL AND {VALUE.format("v")} <> ''),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS m FROM sets a JOIN sets b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
WHERE 10 * m >= 7 * (x.n + y.n - m)"""

_P2 = """
WITH latest AS (SELECT * FROM retrieved WHERE id IS NOT NULL AND cand_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, cand_id ORDER BY seq DESC) = 1),
ranked AS (SELECT l.id, l.cand_id, m.top_k, row_number() OVER (PARTITION BY l.id ORDER BY l.score DESC, l.cand_id) AS place
  FROM latest l JOIN retrieval_metadata m ON m.id = l.id WHERE l.score IS NOT NULL AND NOT isnan(l.score))
SELECT id, place, cand_id FROM ranked WHERE place <= top_k"""

_P3_ROWS = f"""
WITH {_CURRENT}, {_FOODS},
task AS (SELECT id, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS split, source, actual_food, molecules FROM mfp),
sets AS (SELECT DISTINCT id, split, {VALUE.format("v")} AS v FROM (SELECT id, split, unnest(molecules) AS v FROM task)
  WHERE v IS NOT NULL AND {VALUE.format("v")} <> ''),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
common AS (SELECT a.id AS id, b.id AS other, count(*) AS m FROM sets a JOIN sets b ON a.v = b.v
  WHERE a.split IN ('dev', 'test') AND b.split = 'train' GROUP BY 1, 2),
demos AS (SELECT id, d.id AS other, d.actual_food AS food FROM (SELECT id, unnest(retrieved) AS d FROM retrieval_metadata)),
rows AS (
  SELECT 'molecules' AS kind, c.id, other FROM common c JOIN sizes x ON x.id = c.id JOIN sizes y ON y.id = other
  WHERE 10 * m >= 9 * (x.n + y.n - m)
  UNION ALL
  SELECT DISTINCT 'food', d.id, d.other FROM demos d JOIN foods f ON f.food_name = {NAME.format("d.food")}
  JOIN task t ON t.id = d.id JOIN foods g ON g.food_name = {NAME.format("t.actual_food")}
  WHERE f.entity_id = g.entity_id AND d.other <> d.id)"""

_P3 = _P3_ROWS + " SELECT DISTINCT kind, least(id, other) AS id_a, greatest(id, other) AS id_b FROM rows"
_P3_REPORT = _P3_ROWS + """
SELECT kind, nullif(split, '') AS split, source, count(*) AS n_pairs, count(DISTINCT rows.id) AS n_records
FROM rows LEFT JOIN task ON task.id = rows.id GROUP BY 1, 2, 3"""

_P4_ROWS = f"""
WITH parsed AS (SELECT line_key AS key, CAST(raw AS JSON) AS j FROM prediction_lines WHERE json_valid(raw)),
fields AS (SELECT key, j, unnest(json_keys(j)) AS f FROM parsed WHERE json_type(j) = 'OBJECT'),
vals AS (SELECT key, f, json_extract(j, '$."' || f || '"') AS v FROM fields),
lines AS (SELECT key, string_agg(f || chr(30) || CASE WHEN json_type(v) = 'NULL' THEN chr(2)
    ELSE {NAME.format("json_extract_string(v, '$')")} END, chr(31) ORDER BY f) AS c FROM vals GROUP BY key),
members AS (
  SELECT DISTINCT 'line' AS kind, key, c FROM lines
  UNION ALL
  SELECT DISTINCT 'cache', entry_key, coalesce({NAME.format("food_key")}, chr(2)) || chr(31) || coalesce({NAME.format("category")}, chr(2)) FROM food_category_cache),
groups AS (SELECT kind, c, min(key) AS first_key, count(*) AS copies FROM members GROUP BY 1, 2)"""

_P4 = _P4_ROWS + """
SELECT first_key, key AS copy_key FROM members JOIN groups USING (kind, c) WHERE key <> first_key"""
_P4_COLLAPSED = _P4_ROWS + " SELECT kind, first_key, copies FROM groups"

_P5_ROWS = f"""
WITH {_CURRENT},
raw AS (SELECT id, unnest(molecules) AS v FROM mfp UNION ALL SELECT id, unnest(missing_molecules) FROM mpc),
sets AS (SELECT DISTINCT id, {VALUE.format("v")} AS v FROM raw WHERE v IS NOT NULL AND {VALUE.format("v")} <> ''),
total AS (SELECT count(DISTINCT id) AS n FROM sets),
one AS (SELECT v, count(*) AS n FROM sets GROUP BY v),
two AS (SELECT a.v AS molecule_a, b.v AS molecule_b, count(*) AS n_ab FROM sets a JOIN sets b ON a.id = b.id AND a.v < b.v GROUP BY 1, 2),
pairs AS (SELECT molecule_a, molecule_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM two
  JOIN one x ON x.v = molecule_a JOIN one y ON y.v = molecule_b, total WHERE n_ab >= 5)"""


def _xlogx(e: str) -> str:
    return f"(CASE WHEN {e} > 0 THEN CAST({e} AS DOUBLE) * ln(CAST({e} AS DOUBLE)) ELSE 0 END)"


_CELLS = " + ".join(_xlogx(e) for e in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)"))
_SIDES = " + ".join(_xlogx(e) for e in ("n_a", "(n - n_a)", "n_b", "(n - n_b)"))
_P5 = _P5_ROWS + " SELECT molecule_a, molecule_b FROM pairs WHERE 1000 * n_ab >= 2 * n AND n_ab * n >= 3 * n_a * n_b"
_P5_LLR = _P5_ROWS + f"""
SELECT molecule_a, molecule_b, n_ab, n_a, n_b, round(CAST(n_ab * n AS DOUBLE) / CAST(n_a * n_b AS DOUBLE), 6) AS lift,
  round(2.0 * ({_CELLS} - ({_SIDES}) + {_xlogx("n")}), 4) AS llr FROM pairs"""
_P5_PAIRS = _P5_LLR.replace(" WHERE n_ab >= 5)", ")")

_P6 = f"""
WITH {_FOODS},
names AS (SELECT 'predicted_food' AS field, n AS name FROM parts UNION ALL SELECT 'predicted_category', category FROM food_categories),
refs AS (SELECT 'predicted_food' AS field, food_name AS k, entity_id AS canon_id FROM foods
  UNION ALL SELECT 'predicted_category', {NAME.format("category")}, min(category_id) FROM food_categories GROUP BY 2),
cells AS (
  SELECT detail_id, 'predicted_food' AS field, predicted_food AS value FROM mfp_eval_details
  WHERE predicted_food NOT IN (SELECT entity_alias_readable FROM food_entities WHERE entity_alias_readable IS NOT NULL)
  UNION ALL
  SELECT detail_id, 'predicted_category', predicted_category FROM mfp_eval_details
  WHERE predicted_category NOT IN (SELECT category FROM food_categories WHERE category IS NOT NULL)),
typed AS (SELECT * FROM cells WHERE value IS NOT NULL AND regexp_replace(value, '[\\s\\p{{Z}}]+', '', 'g') <> ''),
plain AS (SELECT DISTINCT field, value, {VALUE.format("value")} AS w FROM typed),
cut AS (SELECT field, string_split(w, ' ') AS b FROM (SELECT DISTINCT field, w FROM plain) WHERE contains(w, ' ')),
parts_ AS (SELECT field, b, unnest(generate_series(1, least(3, len(b) - 1))) AS p FROM cut),
ends AS (SELECT field, b[1 : p] AS phrase, array_to_string(b[p + 1 :], '') AS rest FROM parts_ UNION ALL SELECT field, b[len(b) - p + 1 :], array_to_string(b[1 : len(b) - p], '') FROM parts_),
phrases AS (SELECT ends.field, phrase FROM ends JOIN refs ON refs.field = ends.field AND refs.k = rest GROUP BY 1, 2 HAVING count(DISTINCT rest) >= 2),
beside AS (SELECT DISTINCT field, unnest(phrase) AS q FROM phrases),
words AS (SELECT DISTINCT field, unnest(string_split({VALUE.format("name")}, ' ')) AS q FROM names WHERE name IS NOT NULL),
qualifiers AS (SELECT field, list(q) AS qs FROM beside ANTI JOIN words USING (field, q) GROUP BY field),
parted AS (SELECT plain.field, value, w, string_split(w, ' ') AS a, coalesce(qs, []) AS qs FROM plain LEFT JOIN qualifiers ON qualifiers.field = plain.field),
bounds AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, len(a)), lambda i: NOT list_contains(qs, a[i]) OR i = len(a))), 1) AS lo FROM parted),
bare AS (SELECT field, value, w, a[lo : coalesce(list_max(list_filter(generate_series(1, len(a)), lambda i: i >= lo AND (NOT list_contains(qs, a[i]) OR i = lo))), len(a))] AS b FROM bounds),
keys AS (SELECT field, value, k, min(form) AS form FROM (SELECT field, value, unnest([0, 1, 2, 3]) AS form, unnest([replace(w, ' ', ''), array_to_string(b, ''),
  b[len(b)] || array_to_string(b[1 : len(b) - 1], ''), array_to_string(b[2 : len(b)], '') || b[1]]) AS k FROM bare) WHERE k <> '' GROUP BY 1, 2, 3),
near AS (SELECT keys.field, value, arg_min(canon_id, levenshtein(keys.k, refs.k) * 10000000 + form * 1000000 + canon_id) AS canon_id
  FROM keys JOIN refs ON keys.field = refs.field AND abs(length(keys.k) - length(refs.k)) <= 2
  WHERE levenshtein(keys.k, refs.k) <= least(2, length(refs.k) // 3) GROUP BY 1, 2)
SELECT detail_id, typed.field, coalesce(near.canon_id, -1) AS canon_id FROM typed LEFT JOIN near ON near.field = typed.field AND near.value = typed.value"""

_P7 = f"""
WITH {_CURRENT}, {_FOODS},
rows AS (SELECT actual_food AS food, split FROM mfp UNION ALL SELECT target_food, split FROM mpc)
SELECT entity_id FROM rows JOIN foods ON food_name = {NAME.format("food")}
WHERE split IS NOT NULL AND regexp_replace(split, '^\\s+|\\s+$', '', 'g') <> ''
GROUP BY entity_id HAVING count(DISTINCT lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g'))) > 1"""

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _runs(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS run
      FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i
            FROM (SELECT {key}, {_WORDS.format("text")} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12))"""


_P9 = f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id')} JOIN {_runs('eval_passages', 'item_id')} USING (run)"

_P9_CLEANED = rf"""
WITH pieces AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS a FROM documents WHERE text <> '')),
marked AS (SELECT *, regexp_matches(p, '^[\p{{L}}\p{{N}}]') AS is_word FROM pieces),
words AS (SELECT doc_id, i, lower(p) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked WHERE is_word),
lists AS (SELECT doc_id, list(w ORDER BY k) AS w FROM words GROUP BY doc_id),
runs AS (SELECT doc_id, k, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM lists WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT doc_id, k + unnest(generate_series(0, 11)) AS k FROM runs SEMI JOIN {_runs('eval_passages', 'item_id')} g ON g.run = runs.run),
gone AS (SELECT doc_id, i, hits.k IS NOT NULL AS hit FROM words LEFT JOIN hits USING (doc_id, k)),
counts AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS removed_words, count(*) AS n FROM gone GROUP BY doc_id),
around AS (SELECT m.doc_id, m.i, p, is_word, coalesce(hit, false) AS hit, coalesce(lag(hit) OVER o, false) AS before, coalesce(lead(hit) OVER o, false) AS after
  FROM marked m LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.i = m.i WINDOW o AS (PARTITION BY m.doc_id ORDER BY m.i)),
cut AS (SELECT doc_id, coalesce(string_agg(p, '' ORDER BY i) FILTER (WHERE NOT (hit OR (NOT is_word AND before AND after))), '') AS text FROM around GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(removed_words > 0.5 * n, false) THEN '' WHEN coalesce(removed_words, 0) > 0 THEN cut.text ELSE d.text END AS text,
  coalesce(removed_words, 0) AS removed_words, coalesce(removed_words > 0.5 * n, false) AS dropped
FROM documents d LEFT JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_found": _P2,
        "p3_found": _P3,
        "p3_report": _P3_REPORT,
        "p4_found": _P4,
        "p4_collapsed": _P4_COLLAPSED,
        "p5_found": _P5,
        "p5_llr": _P5_LLR,
        "p5_pairs": _P5_PAIRS,
        "p6_found": _P6,
        "p7_found": _P7,
        "p9_found": _P9,
        "p9_cleaned": _P9_CLEANED,
    }
