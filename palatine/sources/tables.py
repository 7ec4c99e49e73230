"""Reference tables, caches and evidence as lookup DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.functions.normalize import category_head, compact_text, entropy_key, functional_groups, name_text, strip, surface_text
from palatine.functions.parse import kind_of, strict_json

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def read_table(spark: SparkSession, source: str, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of a folder (``source``/``name``.``fmt``) or, with ``jdbc``, of a database (``source`` is the URL)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=source, dbtable=quoted(name), **options).load()
    return spark.read.format(fmt).options(**options).load(f"{source}/{name}.{fmt}")


def quoted(name: str) -> str:
    """An SQL identifier in double quotes."""
    return '"' + name.replace('"', '""') + '"'


def catalog(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, ordinal) of the session's tables and views."""
    rows = [(t.name, c.name, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


def require_tables(spark: SparkSession, *names: str) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise LookupError(f"missing tables: {', '.join(missing)}")


def pick_column(df: DataFrame, *candidates: str) -> str:
    """The first of ``candidates`` that ``df`` has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise LookupError(f"none of {', '.join(candidates)} in {', '.join(df.columns)}")
    return found


def food_categories(foods: DataFrame, order: str = "entity_id") -> DataFrame:
    """(food, category): the category head of each readable name (exact, case-sensitive); of several rows the last in ``order``."""
    return (
        foods.where("category <> '' and entity_alias_readable <> ''")
        .groupBy(F.col("entity_alias_readable").alias("food"))
        .agg(F.max_by(category_head("category"), F.col(order)).alias("category"))
    )


def molecule_groups(molecules: DataFrame) -> DataFrame:
    """(molecule, groups): the functional groups of each named molecule by its surface text; of several rows the last id."""
    key, name = pick_column(molecules, "id", "molecule_id"), pick_column(molecules, "common_name", "name", "iupac_name")
    return (
        molecules.where(F.col(name) != "")
        .groupBy(surface_text(name).alias("molecule"))
        .agg(F.max_by(functional_groups("functional_groups"), F.col(key)).alias("groups"))
    )


def category_cache(cache: DataFrame, vocabulary: DataFrame, order: str = "entry_key") -> DataFrame:
    """(food, category) of a judge's cache (food_key, category): only categories of the ``vocabulary`` (category) count, in its spelling."""
    known = vocabulary.where("category is not null").groupBy(compact_text("category").alias("c")).agg(F.max("category").alias("spelling"))
    hits = cache.where("food_key is not null and category is not null").withColumn("c", compact_text("category")).join(known, "c")
    return hits.groupBy(surface_text("food_key").alias("food")).agg(F.max_by("spelling", order).alias("category"))


def groups_cache(cache: DataFrame) -> DataFrame:
    """(molecule, groups) of a judge's cache (molecule, groups): all non-blank texts, sorted."""
    texts = F.filter(F.transform("groups", strip), lambda g: g != "")
    return cache.groupBy(surface_text("molecule").alias("molecule")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(texts)))).alias("groups"))


def evidence_by_molecule(rows: DataFrame) -> DataFrame:
    """(key, snippets) of evidence rows (key, pos, snippet), keyed by stripped lower case."""
    return _packed(rows.withColumn("key", entropy_key("key")))


def evidence_by_food(rows: DataFrame) -> DataFrame:
    """As evidence_by_molecule, keyed by normalised name; empty keys are dropped."""
    return _packed(rows.withColumn("key", name_text("key")).where("key <> ''"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.where("snippet is not null").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda s: s["snippet"]).alias("snippets"))


def evidence_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pos, snippet) of evidence held as JSON: an array gives its items, an object or scalar one snippet, null none.

    Evidence is exchanged as JSON or parquet; serialised program objects are
    not read, since loading them could run code.
    """
    v = strict_json(value)
    items = F.when(kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<string>")).when(v.isNotNull() & (kind_of(v) != "VOID"), F.array(F.try_variant_get(v, "$", "string")))
    return df.select(F.col(key).alias("key"), F.posexplode(items).alias("pos", "snippet"))


def retrieval_rows(metadata: DataFrame, version: str | None = None, column: str = "protocol_version") -> DataFrame:
    """Retrieval metadata; with a ``version``, a row of another one fails the run."""
    if version is None:
        return metadata
    wrong = F.raise_error(F.concat(F.lit("wrong retrieval protocol: "), F.coalesce(F.col(column), F.lit("none"))))
    return metadata.withColumn(column, F.when(F.col(column) == version, F.col(column)).otherwise(wrong.cast("string")))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, for lineage."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
