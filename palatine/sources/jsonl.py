"""JSON-lines scans with an explicit policy for bad lines.

Lines are read as text, so that blank lines, bad JSON and values that are no
objects can be told apart; ``ord`` keeps the order of the files (increasing,
not dense).  Everything is lazy and splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palatine.functions.normalize import clean_prediction, strip
from palatine.functions.parse import coerce_list, kind_of, strict_json, text_field

POLICIES = ("fail", "count", "skip")


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ord, file, raw, row): non-blank lines; ``row`` is the object as VARIANT, null for a bad line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    v = strict_json("raw")
    return lines.where(strip("raw") != "").withColumn("row", F.when(kind_of(v) == "OBJECT", v))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, policy: str = "fail", require_id: bool = False) -> DataFrame:
    """Rows of a JSON-lines file by ``schema``, with ``ord``.

    ``fail`` raises at the first bad line (or null id, with ``require_id``),
    naming the file and the line's text; ``skip`` leaves bad lines out;
    ``count`` keeps them as null rows with ``_bad`` true, for bad_lines().
    Ids may be numbers or texts: they always come out as STRING.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = scan_lines(spark, path)
    row = F.col("row")
    if policy == "fail":
        said = F.concat(F.lit("bad JSON object in "), F.col("file"), F.lit(": "), F.substr(F.col("raw"), F.lit(1), F.lit(200)))
        row = F.coalesce(row, F.raise_error(said).cast("variant"))
    cells = [_cell(row, f).alias(f.name) for f in fields]
    if require_id:
        missing = F.raise_error(F.concat(F.lit("row without id in "), F.col("file")))
        cells = [F.coalesce(c, missing.cast("string")).alias("id") if f.name == "id" else c for c, f in zip(cells, fields)]
    bad = F.col("row").isNull().alias("_bad")
    if policy == "skip":
        lines = lines.where(F.col("row").isNotNull())
    return lines.select("ord", *cells, *([bad] if policy == "count" else []))


def _cell(row: Column, field: T.StructField) -> Column:
    path = "$['" + field.name.replace("'", "\\'") + "']"
    return F.try_variant_get(row, path, field.dataType.simpleString())


def bad_lines(rows: DataFrame) -> int:
    """Number of bad lines of a scan with policy ``count``."""
    return rows.where("_bad").count()


def food_predictions(lines: DataFrame) -> DataFrame:
    """(id, predicted_food, status, ord) of prediction lines (ord, row).

    predicted_food, or prediction where that field is absent, must be a
    non-blank string and is cleaned; status ``ok`` or ``failed``.  Lines
    without an id or object count as failed with a null id.
    """
    row = F.col("row")
    value = F.when(_has(row, "predicted_food"), text_field(row, "$.predicted_food")).otherwise(text_field(row, "$.prediction"))
    food = F.nullif(clean_prediction(value), F.lit(""))
    return lines.select(
        F.try_variant_get(row, "$.id", "string").alias("id"),
        food.alias("predicted_food"),
        F.when(food.isNotNull() & F.try_variant_get(row, "$.id", "string").isNotNull(), "ok").otherwise("failed").alias("status"),
        "ord",
    )


def molecule_predictions(lines: DataFrame) -> DataFrame:
    """(id, predicted_molecules, status, ord); an empty list is a prediction, a truthy error or another type is none."""
    row = F.col("row")
    at = lambda f: F.try_variant_get(row, f"$.{f}", "variant")
    found = coerce_list(F.when(_has(row, "predicted_molecules"), at("predicted_molecules")).otherwise(at("prediction")))
    error = F.coalesce(F.try_variant_get(row, "$.error", "string"), F.lit(""))
    good = found.isNotNull() & error.isin("", "false", "0", "[]", "{}") & F.try_variant_get(row, "$.id", "string").isNotNull()
    return lines.select(F.try_variant_get(row, "$.id", "string").alias("id"), F.when(good, found).alias("predicted_molecules"), F.when(good, "ok").otherwise("failed").alias("status"), "ord")


def _has(row: Column, field: str) -> Column:
    """Whether the object has the field, null value or not."""
    return F.array_contains(F.coalesce(F.json_object_keys(F.to_json(row)), F.array().cast("array<string>")), field)


def last_success(predictions: DataFrame, *values: str) -> DataFrame:
    """(id, values): the last successful row of each id; a later failure does not undo it."""
    payload = F.struct(*[F.col(v) for v in values])
    return predictions.where("status = 'ok'").groupBy("id").agg(F.max_by(payload, "ord").alias("p")).select("id", *[F.col(f"p.{v}").alias(v) for v in values])


def failed_ids(predictions: DataFrame) -> DataFrame:
    return predictions.where("status = 'failed' and id is not null").select("id").distinct()
