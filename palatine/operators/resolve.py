"""Name resolution by levels, set lookup, and reconstruction of set-completion tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palatine.functions.normalize import name_text, strip, synonym_parts
from palatine.operators.physical import checkpoint, small_side

#: Name fields of an entity in the order in which they decide; list fields count whole and in parts.
LEVELS = ("entity_alias_readable", "entity_alias", "natural_source_name", "entity_alias_basket", "entity_alias_synonyms", "category_readable", "category")
LISTS = ("entity_alias_basket", "entity_alias_synonyms")


def name_index(entities: DataFrame, levels: tuple[str, ...] = LEVELS, lists: tuple[str, ...] = LISTS, key: str = "entity_id") -> DataFrame:
    """(level, name, entity_id): every normalised name of every entity with the level of its field."""
    present = [c for c in levels if c in entities.columns]

    def at_level(i: int):
        return lambda v: F.struct(F.lit(i).alias("level"), name_text(v).alias("name"))

    texts = [F.concat(F.array(F.col(c)), synonym_parts(c)) if c in lists else F.array(F.col(c)) for c in present]
    names = [F.transform(x, at_level(i)) for i, x in enumerate(texts)]
    return entities.select(F.col(key).alias("entity_id"), F.explode(F.concat(*names)).alias("n")).select("n.level", "n.name", "entity_id").where("name <> ''").distinct()


def resolve_names(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """``rows`` with (match_status, entity_id, candidates).

    The first level at which a name is found decides: one entity is
    ``matched_unique``, several are ``ambiguous`` and no further level is
    tried; ``unmatched`` without any.  The index is first reduced to the
    deciding level of each name, so each row meets at most one index row.
    """
    by_level = index.groupBy("name", "level").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    deciding = by_level.groupBy("name").agg(F.min_by("ids", "level").alias("candidates"))
    found = rows.withColumn("_name", name_text(column)).join(small_side(deciding.withColumnRenamed("name", "_name")), "_name", "left").drop("_name")
    n = F.coalesce(F.size("candidates"), F.lit(-1))
    return (
        found.withColumn("match_status", F.when(n == 1, "matched_unique").when(n > 1, "ambiguous").otherwise("unmatched"))
        .withColumn("entity_id", F.when(n == 1, F.element_at("candidates", 1)))
        .withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>")))
    )


def full_sets(links: DataFrame, items: DataFrame, item_key: str = "molecule_id", name: str = "common_name") -> DataFrame:
    """(entity_id, full): the distinct names of an entity's items, ordered by lower case, then by spelling."""
    named = links.join(items.select(F.col(item_key), strip(name).alias("_n")), item_key).where("_n <> ''")
    return named.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("_n").alias("low"), F.col("_n").alias("n")))), lambda s: s["n"]).alias("full"))


def reconstruct(tasks: DataFrame, full: DataFrame) -> DataFrame:
    """(…, status, partial, n): what is left of each task's full set without its missing items.

    ``tasks`` has (entity_id, missing, match_status), ``full`` (entity_id,
    full).  Status in order: invalid_food, invalid_missing_molecules, unmatched
    or ambiguous, empty_full_molecules, missing_not_subset_of_full,
    partial_empty, ok.  ``n`` counts the missing items with repeats.
    """
    rows = tasks.join(small_side(checkpoint(full)), "entity_id", "left")
    # each step names what the next uses more than once, so that nothing is normalised twice
    rows = rows.withColumn("_whole", F.coalesce("full", F.array().cast("array<string>"))).withColumn("_gone", F.transform("missing", name_text)).withColumn("_keys", F.transform("_whole", name_text))
    rows = rows.withColumn("_outside", F.size(F.array_except("_gone", "_keys"))).withColumn(
        "_partial", F.transform(F.filter(F.arrays_zip("_whole", "_keys"), lambda z: ~F.array_contains("_gone", z["_keys"])), lambda z: z["_whole"])
    )
    status = (
        F.when(strip(F.coalesce("food", F.lit(""))) == "", "invalid_food")
        .when(F.col("missing").isNull() | (F.size("missing") == 0), "invalid_missing_molecules")
        .when(F.col("match_status") != "matched_unique", F.col("match_status"))
        .when(F.size("_whole") == 0, "empty_full_molecules")
        .when(F.col("_outside") > 0, "missing_not_subset_of_full")
        .when(F.size("_partial") == 0, "partial_empty")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    good = F.col("status") == "ok"
    return rows.withColumn("partial", F.when(good, F.col("_partial"))).withColumn("n", F.when(good, F.size("missing")).cast("bigint")).drop("_whole", "_gone", "_keys", "_outside", "_partial")


def status_histogram(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def stats(rows: DataFrame, value) -> DataFrame:
    """(minimum, maximum, mean) of a number; zeros without rows."""
    v = F.col(value) if isinstance(value, str) else value
    return rows.agg(F.coalesce(F.min(v), F.lit(0)).alias("minimum"), F.coalesce(F.max(v), F.lit(0)).alias("maximum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"))
