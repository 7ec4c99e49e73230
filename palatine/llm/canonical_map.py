"""Mapping freely typed values to a reference list, in SQL: a partition-based pigeonhole join.

Every reference key is cut into K + 1 segments.  If a typed key is within edit
distance K of a reference key, at least one segment stands in it unchanged,
shifted by at most K places; so an equality join on (reference length, segment
number, substring) finds every candidate, and the built-in ``levenshtein``
verifies them.  What nothing is near to is found by an anti-join.

Keys are the name keys (lower case, letters and digits).  A typed value is tried
as it stands, then without qualifying words at its ends, then with its last or
first word moved to the other end ("Currant, Black").  Qualifying words are
learned from the typed values: words of phrases (up to PHRASE words) that stand
before or after the whole names of LEAST or more different entries; words that
stand in any listed name are none, so qualifying words never decide between
entries.

The distance allowed is K = 2, less for keys under six letters (a third of the
reference key's length).  The nearest key wins, of several at the same distance
the one of the earlier form, then the smallest id.

Defined cases: null and blank values are no values; a value with no letter or
digit means nothing on the list (-1); null or empty reference names are left
out; repeated values are resolved once; an empty list maps everything to -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from palatine.llm.common import HOT_SHARE, checkpoint, small_is

K = 2
#: Different entries beside whose names a qualifying phrase stands at least, and the words it has at most.
LEAST, PHRASE = 2, 3

_KEY = r"regexp_replace(lower({0}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '')"
_WORDS = r"trim(regexp_replace(lower({0}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' '))"


def words_sql(c: str) -> str:
    """Words of a text, separated by single blanks."""
    return _WORDS.format(c)


#: (name, canon_id) of a list of entities: the readable name and every synonym.
ENTITY_NAMES = """
    SELECT entity_alias_readable AS name, entity_id AS canon_id FROM {entities}
    UNION ALL SELECT s.name, entity_id FROM {entities} LATERAL VIEW explode(split(entity_alias_synonyms, '[;,|]')) s AS name"""


def keys_sql() -> str:
    """(ref_key, canon_id) of {names} (name, canon_id); a key that several entries carry goes to the smallest id."""
    key = _KEY.format("name")
    return f"SELECT {key} AS ref_key, CAST(min(canon_id) AS BIGINT) AS canon_id FROM {{names}} WHERE {key} <> '' AND canon_id IS NOT NULL GROUP BY {key}"


def qualifiers_sql(least: int = LEAST, most: int = PHRASE) -> str:
    """(word): the qualifying words of {values} (value) beside the keys of {keys} and the words of {names}."""
    return f"""
    WITH plain AS (SELECT DISTINCT split({words_sql("value")}, ' ') AS w FROM {{values}}),
    cut AS (SELECT w, size(w) AS n, c.p FROM plain LATERAL VIEW explode(sequence(1, least({most}, size(w) - 1))) c AS p WHERE size(w) > 1),
    ends AS (
      SELECT slice(w, 1, p) AS phrase, array_join(slice(w, p + 1, n - p), '') AS rest FROM cut
      UNION ALL SELECT slice(w, n - p + 1, p), array_join(slice(w, 1, n - p), '') FROM cut),
    beside AS (SELECT phrase FROM ends JOIN {{keys}} k ON rest = k.ref_key GROUP BY phrase HAVING count(DISTINCT rest) >= {least})
    SELECT DISTINCT b.word FROM (SELECT explode(phrase) AS word FROM beside) b
    LEFT ANTI JOIN (SELECT explode(split({words_sql("name")}, ' ')) AS word FROM {{names}}) n ON b.word = n.word"""


def variants_sql() -> str:
    """(value, key, form): the keys a typed value is tried under and the first form that gives each; {values} has (value), {qualifiers} (word)."""
    return rf"""
    WITH any AS (SELECT coalesce(concat('(', array_join(array_sort(collect_set(word)), '|'), ')'), '') AS words FROM {{qualifiers}}),
    plain AS (SELECT value, {words_sql("value")} AS w FROM {{values}}),
    bare AS (SELECT /*+ BROADCAST(any) */ value, w, regexp_replace(regexp_replace(w, concat('^(', any.words, ' )+'), ''), concat('( ', any.words, ')+$'), '') AS b FROM plain CROSS JOIN any)
    SELECT value, key, min(form) AS form FROM (
      SELECT value, posexplode(array(
        replace(w, ' ', ''),
        replace(b, ' ', ''),
        replace(concat(regexp_extract(b, '([^ ]+)$', 1), regexp_replace(b, ' ?[^ ]+$', '')), ' ', ''),
        replace(concat(regexp_replace(b, '^[^ ]+ ?', ''), regexp_extract(b, '^([^ ]+)', 1)), ' ', ''))) AS (form, key) FROM bare)
    WHERE key <> '' GROUP BY value, key"""


def segments_sql(k: int = K) -> str:
    """(ref_key, canon_id, ref_len, seg, at, part): the k + 1 segments of each reference key."""
    return f"""
    SELECT ref_key, canon_id, length(ref_key) AS ref_len, seg,
      CAST(floor(seg * length(ref_key) / {k + 1}) AS INT) + 1 AS at,
      substring(ref_key, CAST(floor(seg * length(ref_key) / {k + 1}) AS INT) + 1,
        CAST(floor((seg + 1) * length(ref_key) / {k + 1}) AS INT) - CAST(floor(seg * length(ref_key) / {k + 1}) AS INT)) AS part
    FROM {{refs}} LATERAL VIEW explode(sequence(0, {k})) s AS seg"""


def probes_sql(k: int = K) -> str:
    """(value, key, form, ref_len, seg, part): the substrings of a typed key that a segment may equal.

    With a length difference d, segment i may start from i places before to i
    places behind its own place, and, seen from the end, from d - (k - i) to
    d + (k - i) places behind it.
    """
    begin = f"CAST(floor(seg * ref_len / {k + 1}) AS INT)"
    width = f"(CAST(floor((seg + 1) * ref_len / {k + 1}) AS INT) - {begin})"
    return f"""
    WITH lengths AS (
      SELECT value, key, form, ref_len, seg, length(key) - ref_len AS d
      FROM {{variants}} LATERAL VIEW explode(sequence(greatest(1, length(key) - {k}), length(key) + {k})) l AS ref_len
        LATERAL VIEW explode(sequence(0, {k})) s AS seg)
    SELECT DISTINCT value, key, form, ref_len, seg, substring(key, {begin} + 1 + shift, {width}) AS part
    FROM lengths LATERAL VIEW explode(sequence(-{k}, {k})) h AS shift
    WHERE shift BETWEEN greatest(-seg, d - ({k} - seg)) AND least(seg, d + ({k} - seg))
      AND {begin} + shift >= 0 AND {begin} + shift + {width} <= length(key)"""


def mapped_values(values: DataFrame, names: DataFrame, k: int = K) -> DataFrame:
    """(value, canon_id) of every distinct ``value`` in ``values``; -1 if it means nothing in ``names`` (name, canon_id)."""
    spark = values.sparkSession
    keys = checkpoint(spark.sql(keys_sql(), names=names))
    distinct = checkpoint(spark.sql("SELECT DISTINCT value FROM {values} WHERE value IS NOT NULL", values=values))
    qualifiers = checkpoint(spark.sql(qualifiers_sql(), values=distinct, keys=keys, names=names))
    variants = checkpoint(spark.sql(variants_sql(), values=distinct, qualifiers=qualifiers))
    hint = "/*+ BROADCAST(r) */" if small_is(keys) else ""
    # most values are on the list as they are; only the others are probed
    exact = checkpoint(spark.sql(f"SELECT {hint} v.value, min(struct(v.form, r.canon_id)).canon_id AS canon_id FROM {{variants}} v JOIN {{keys}} r ON v.key = r.ref_key GROUP BY v.value", variants=variants, keys=keys))
    probes = spark.sql(probes_sql(k), variants=spark.sql("SELECT v.* FROM {variants} v LEFT ANTI JOIN {exact} e ON v.value = e.value", variants=variants, exact=exact))
    segments = checkpoint(spark.sql(segments_sql(k), refs=keys))
    hint = "/*+ BROADCAST(r) */" if small_is(segments) else ""
    near = spark.sql(
        f"""
        SELECT value, min(struct(dist, form, canon_id)).canon_id AS canon_id FROM (
          SELECT {hint} p.value, p.form, r.canon_id, levenshtein(p.key, r.ref_key, {k}) AS dist, least({k}, r.ref_len DIV 3) AS most
          FROM {{probes}} p JOIN {{segments}} r ON p.ref_len = r.ref_len AND p.seg = r.seg AND p.part = r.part)
        WHERE dist >= 0 AND dist <= most GROUP BY value""",
        probes=probes,
        segments=segments,
    )
    found = checkpoint(spark.sql("SELECT * FROM {exact} UNION ALL SELECT * FROM {near}", exact=exact, near=near))
    return spark.sql(
        """SELECT value, canon_id FROM {found}
        UNION ALL SELECT v.value, CAST(-1 AS BIGINT) FROM {distinct} v LEFT ANTI JOIN {found} f ON v.value = f.value""",
        found=found,
        distinct=distinct,
    )


def map_column(rows: DataFrame, names: DataFrame, listed: DataFrame, k: int = K) -> DataFrame:
    """(detail_id, canon_id) of the ``rows`` (detail_id, value) whose value is neither blank nor, letter for letter, in ``listed`` (value).

    Values in more than a thousandth of the rows, at most a thousand, are
    broadcast, so that their rows are not shuffled.
    """
    spark = rows.sparkSession
    listed = spark.sql("SELECT DISTINCT value FROM {listed} WHERE value IS NOT NULL", listed=listed)
    hint = "/*+ BROADCAST(l) */" if small_is(listed) else ""
    typed = spark.sql(rf"SELECT {hint} r.detail_id, r.value FROM (SELECT detail_id, value FROM {{rows}} WHERE value RLIKE '[^\\s\\p{{{{Z}}}}]') r LEFT ANTI JOIN {{listed}} l ON r.value = l.value", rows=rows, listed=listed)
    counts = checkpoint(spark.sql("SELECT value, count(*) AS n FROM {typed} GROUP BY value", typed=typed))
    mapped = checkpoint(spark.sql("SELECT m.value, m.canon_id, c.n FROM {mapped} m JOIN {counts} c ON m.value = c.value", mapped=mapped_values(counts.select("value"), names, k), counts=counts))
    bar = spark.sql(f"SELECT greatest(1, coalesce(sum(n), 0) DIV {HOT_SHARE}) AS bar FROM {{counts}}", counts=counts).first()[0]
    hot, cold = (spark.sql(f"SELECT value, canon_id FROM {{mapped}} WHERE n {op} {bar}", mapped=mapped) for op in (">", "<="))
    return spark.sql(
        """SELECT /*+ BROADCAST(h) */ t.detail_id, h.canon_id FROM {typed} t JOIN {hot} h ON t.value = h.value
        UNION ALL SELECT t.detail_id, c.canon_id FROM (SELECT /*+ BROADCAST(h) */ t.* FROM {typed} t LEFT ANTI JOIN {hot} h ON t.value = h.value) t JOIN {cold} c ON t.value = c.value""",
        typed=typed,
        hot=hot,
        cold=cold,
    )
