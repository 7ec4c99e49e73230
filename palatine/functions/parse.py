"""Parsing of model replies with the engine's variant functions.

``try_parse_json`` ignores what follows a value, so a text counts as JSON only
if it also parses wrapped in an array of one element and in an object.  Objects
that repeat a field, and the constants NaN and Infinity, are no JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palatine.functions.normalize import col, name_text, strip

NO_STRINGS = "array<string>"


def strict_json(c: Column | str) -> Column:
    """The text as VARIANT if the whole of it is one JSON value, else null."""
    c = col(c)
    item = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    one = F.try_variant_get(item, "$[0]", "variant").isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull()
    field = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(one, F.try_variant_get(field, "$.v", "variant"))


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _between(c: Column, first: str, last: str) -> Column:
    """From the first ``first`` to the last ``last``."""
    start = F.locate(first, c)
    end = F.length(c) - F.locate(last, F.reverse(c)) + 1
    return F.when((start > 0) & (F.locate(last, c) > 0) & (end > start), F.substr(c, start, end - start + 1))


# What marks a block, a list item and its end in a reply.
FENCE, FENCE_LANGUAGE = "```", "json"
LIST_MARKS, NUMBER_ENDS = ("-", "*", "•"), (".", ")")
QUOTES, ITEM_ENDS, AGENT_ENDS = ('"', "'"), ",;。；", '",'


def _fenced(c: Column) -> Column:
    """What stands between the first two fences, without the name of the language."""
    inner = F.try_element_at(F.split(c, FENCE, 3), F.lit(2))
    named = F.lower(F.left(inner, F.lit(len(FENCE_LANGUAGE)))) == FENCE_LANGUAGE
    return F.when(F.size(F.split(c, FENCE, 3)) == 3, strip(F.when(named, F.substr(inner, F.lit(len(FENCE_LANGUAGE) + 1))).otherwise(inner)))


def _item(line: Column) -> Column:
    """What follows the mark of a list line (a bullet, or digits and their end), null for other lines."""
    mark = F.regexp_extract(line, r"^(\S+)\s+\S", 1)
    number = F.right(mark, F.lit(1)).isin(*NUMBER_ENDS) & F.regexp_like(F.substr(mark, F.lit(1), F.length(mark) - 1), F.lit("^[0-9]+$"))
    return F.when(mark.isin(*LIST_MARKS) | number, strip(F.substr(line, F.length(mark) + 1)))


def _unquoted(c: Column) -> Column:
    """Without one quote at either end."""
    c = F.when(F.left(c, F.lit(1)).isin(*QUOTES), F.substr(c, F.lit(2))).otherwise(c)
    return F.when(F.right(c, F.lit(1)).isin(*QUOTES), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def json_reply(c: Column | str, order: str = "fence_replaces") -> Column:
    """The JSON value in a model reply.

    ``fence_replaces``: a fenced block takes the place of the text; then the
    whole, the outermost object, the outermost array.  ``fence_first``: the
    fence is tried first, then whole, object and array of the original text.
    """
    whole = strip(F.coalesce(col(c), F.lit("")))
    fence = _fenced(whole)
    if order == "fence_replaces":
        base = F.coalesce(fence, whole)
        tries = [base, _between(base, "{", "}"), _between(base, "[", "]")]
    elif order == "fence_first":
        tries = [fence, whole, _between(whole, "{", "}"), _between(whole, "[", "]")]
    else:
        raise ValueError(f"unknown order {order!r}")
    return F.coalesce(*[strict_json(t) for t in tries])


def json_object(c: Column | str, order: str | None = None) -> Column:
    """The reply's JSON object or null; without ``order`` the whole text must be the object."""
    v = strict_json(c) if order is None else json_reply(c, order)
    return F.when(kind_of(v) == "OBJECT", v)


def string_list(v: Column, path: str = "$") -> Column:
    """A JSON array as array<string>; null if there is no array."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(at) == "ARRAY", F.try_variant_get(at, "$", NO_STRINGS))


def bullet_items(c: Column | str, agent: bool = False) -> Column:
    """Items of numbered or bulleted lines.

    Plain: one quote at each end and trailing ``,;。；`` go.  Agent: quotes and
    commas at both ends go, lines that begin with predicted or molecules are
    skipped, repeats are dropped.
    """
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip)
    items = F.filter(F.transform(lines, _item), lambda x: x.isNotNull())
    if agent:
        items = F.transform(items, lambda x: F.btrim(x, F.lit(AGENT_ENDS)))
        items = F.filter(items, lambda x: (x != "") & ~F.lower(x).startswith("predicted") & ~F.lower(x).startswith("molecules"))
        return distinct_names(items)
    items = F.transform(items, lambda x: strip(F.rtrim(_unquoted(x), F.lit(ITEM_ENDS))))
    return F.filter(items, lambda x: x != "")


def _keep_first(items: Column, known: Column, key) -> Column:
    """Items in order whose key is neither empty, in ``known`` nor met before."""
    start = F.struct(F.array().cast(NO_STRINGS).alias("out"), known.alias("seen"))

    def step(s: Column, x: Column) -> Column:
        k = key(x)
        skip = (k == "") | F.array_contains(s["seen"], k)
        return F.when(skip, s).otherwise(F.struct(F.array_append(s["out"], x).alias("out"), F.array_append(s["seen"], k).alias("seen")))

    return F.aggregate(items, start, step)["out"]


def _texts(items: Column) -> Column:
    """Stripped printed forms; null elements print as None."""
    return F.transform(F.coalesce(items, F.array().cast(NO_STRINGS)), lambda x: strip(F.coalesce(x, F.lit("None"))))


def _keys(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast(NO_STRINGS)), name_text), lambda k: k != "")


def distinct_names(items: Column) -> Column:
    """Stripped non-blank items, the first per normalised name; of items without letters and digits one stays."""
    texts = F.filter(_texts(items), lambda x: x != "")
    key = lambda x: F.concat(F.lit("k"), name_text(x))
    return _keep_first(texts, F.array().cast(NO_STRINGS), key)


def clean_predictions(items: Column, known: Column, n: Column) -> Column:
    """At most n new names in order, without known ones and repeats; n null or below 1 gives none."""
    kept = _keep_first(_texts(items), _keys(known), name_text)
    return F.when(n > 0, F.slice(kept, F.lit(1), n.cast("int"))).otherwise(F.array().cast(NO_STRINGS))


def final_molecules(items: Column, known: Column, n: Column) -> Column:
    """clean_predictions with its audit counts; n null or negative sets no limit."""
    texts = _texts(items)
    keys = _keys(known)
    kept = _keep_first(texts, keys, name_text)
    from_known = F.size(F.filter(texts, lambda x: F.array_contains(keys, name_text(x)) & (name_text(x) != "")))
    limited = n.isNotNull() & (n >= 0) & (F.size(kept) > n)
    final = F.when(limited, F.slice(kept, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))).otherwise(kept)
    return F.struct(
        final.alias("molecules"),
        F.size(texts).alias("count_before"),
        F.size(final).alias("count_after"),
        from_known.alias("removed_partial"),
        (F.size(texts) - F.size(kept) - from_known).alias("removed_duplicate_or_empty"),
        F.coalesce(limited, F.lit(False)).alias("truncated"),
        F.size(kept).alias("count_before_truncation"),
    )


def reply_molecules(c: Column | str) -> Column:
    """The molecules of a reply: the object's predicted_molecules, the array itself, or its bulleted lines; else null."""
    v = json_reply(c)
    bullets = bullet_items(c)
    return (
        F.when(kind_of(v) == "OBJECT", string_list(v, "$.predicted_molecules"))
        .when(kind_of(v) == "ARRAY", string_list(v))
        .when(F.size(bullets) > 0, bullets)
    )


def reply_molecules_agent(c: Column | str) -> Column:
    """As reply_molecules, trying more field names and the first hypothesis that has any; else the bullets."""
    v = json_reply(c, "fence_first")
    named = [distinct_names(string_list(v, f"$.{f}")) for f in ("predicted_molecules", "molecules", "missing_molecules")]
    hypotheses = F.when(kind_of(F.try_variant_get(v, "$.hypotheses", "variant")) == "ARRAY", F.try_variant_get(v, "$.hypotheses", "array<variant>"))
    inner = F.transform(F.coalesce(hypotheses, F.array().cast("array<variant>")), lambda h: distinct_names(string_list(h, "$.predicted_molecules")))
    own = distinct_names(string_list(v))
    some = lambda a: F.when(F.size(a) > 0, a)
    first_inner = F.try_element_at(F.filter(inner, lambda a: F.size(a) > 0), F.lit(1))
    return F.coalesce(*[some(a) for a in named], first_inner, some(own), some(bullet_items(c, agent=True)))


def reply_food(c: Column | str) -> Column:
    """A non-blank predicted_food of a strict JSON object, stripped; else null."""
    return valid_text(text_field(json_object(c), "$.predicted_food"))


def text_field(v: Column, path: str) -> Column:
    """A field that is a JSON string; other types are null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(at) == "STRING", F.try_variant_get(at, "$", "string"))


def valid_text(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def hypotheses_foods(c: Column | str, order: str = "fence_first") -> Column:
    """array<struct<predicted_food, rationale>> if exactly three usable hypotheses stand in the reply, else null."""
    v = json_object(c, order)
    raw = F.try_variant_get(F.when(kind_of(F.try_variant_get(v, "$.hypotheses", "variant")) == "ARRAY", v), "$.hypotheses", "array<variant>")
    items = F.transform(raw, lambda h: F.struct(valid_text(text_field(h, "$.predicted_food")).alias("predicted_food"), rationale(h, "$.rationale").alias("rationale")))
    good = F.filter(items, lambda h: h["predicted_food"].isNotNull())
    return F.when(F.size(good) == 3, good)


def rationale(h: Column, path: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(h, path, "string"), F.lit("")))


def hypotheses_molecules(c: Column | str, known: Column, n: Column, order: str = "fence_first") -> Column:
    """array<struct<predicted_molecules, rationale>>: exactly three, each with at least one new molecule; else null."""
    v = json_object(c, order)
    raw = F.try_variant_get(F.when(kind_of(F.try_variant_get(v, "$.hypotheses", "variant")) == "ARRAY", v), "$.hypotheses", "array<variant>")
    items = F.transform(
        raw,
        lambda h: F.struct(
            final_molecules(distinct_names(string_list(h, "$.predicted_molecules")), known, n)["molecules"].alias("predicted_molecules"),
            rationale(h, "$.rationale").alias("rationale"),
        ),
    )
    return F.when((F.size(raw) == 3) & (n > 0) & F.forall(items, lambda h: F.size(h["predicted_molecules"]) > 0), items)


def reviewer_choice(c: Column | str, order: str = "fence_first") -> Column:
    """struct<selected_hypothesis_index, review_reason> if the index is a whole number from 1 to 3, else null."""
    v = json_object(c, order)
    at = F.try_variant_get(v, "$.selected_hypothesis_index", "variant")
    index = F.when(kind_of(at) == "BIGINT", F.try_variant_get(at, "$", "int"))
    return F.when(index.between(1, 3), F.struct(index.alias("selected_hypothesis_index"), rationale(v, "$.review_reason").alias("review_reason")))


def reply_groups(c: Column | str) -> Column:
    """The non-blank strings of functional_groups in a strict JSON object, distinct; the vocabulary is not enforced."""
    v = json_object(c)
    raw = F.try_variant_get(F.when(kind_of(F.try_variant_get(v, "$.functional_groups", "variant")) == "ARRAY", v), "$.functional_groups", "array<variant>")
    texts = F.transform(F.filter(raw, lambda g: kind_of(g) == "STRING"), lambda g: strip(F.try_variant_get(g, "$", "string")))
    return F.array_distinct(F.filter(texts, lambda g: g != ""))


def reply_category(c: Column | str, vocabulary: list[str]) -> Column:
    """The category of a strict JSON object in the vocabulary's (last) spelling, else null."""
    from palatine.functions.normalize import compact_text

    v = json_object(c)
    known = {x.lower().replace(" ", "").replace("-", "").replace("_", ""): x for x in vocabulary}
    spelling = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(spelling, compact_text(F.try_variant_get(v, "$.category", "string")))


def coerce_list(v: Column) -> Column:
    """A prediction field as array<string>: an array, or a text holding one; other types are null.

    Texts are read as JSON array, then with single quotes for double ones,
    else cut at commas between the outer brackets.
    """
    text = strip(F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")))
    quoted = strict_json(F.regexp_replace(F.regexp_replace(text, r"(?<=[\[,]\s{0,3})'|'(?=\s{0,3}[\],])", '"'), r"\\'", "'"))
    parts = F.transform(F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ","), strip)
    items = F.coalesce(string_list(v), string_list(strict_json(text)), string_list(quoted), parts)
    return F.filter(F.transform(items, lambda x: strip(F.coalesce(x, F.lit("None")))), lambda x: x != "")


def joined(items: Column | str, most: int | None = None) -> Column:
    """Items separated by comma and blank; null gives the empty text."""
    items = F.coalesce(col(items), F.array().cast(NO_STRINGS))
    return F.array_join(items if most is None else F.slice(items, F.lit(1), F.lit(most)), ", ")


def numbered_foods(hypotheses: Column | str) -> Column:
    """A numbered block of food hypotheses."""
    return F.array_join(
        F.transform(col(hypotheses), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["predicted_food"], F.lit("\nRationale: "), h["rationale"])),
        "\n\n",
    )


def numbered_molecules(hypotheses: Column | str) -> Column:
    """A numbered block of molecule hypotheses."""
    return F.array_join(
        F.transform(col(hypotheses), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), F.array_join(h["predicted_molecules"], ", "), F.lit("\nRationale: "), h["rationale"])),
        "\n\n",
    )
