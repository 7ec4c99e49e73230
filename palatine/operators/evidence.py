"""Evidence lookup and resolution of retrieved demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palatine.functions.normalize import entropy_key, name_text
from palatine.operators.physical import checkpoint, small_side

NONE = "- no_evidence"


def evidence_blocks(selected: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, block, raw_count, used_count): the snippets of each row's selected items.

    ``selected`` has (id, place, item), ``evidence`` (key, snippets).  An item
    without evidence keeps its place with a placeholder.
    """
    hit = selected.withColumn("key", entropy_key("item")).join(small_side(checkpoint(evidence)), "key", "left")
    none = F.array().cast("array<string>")
    found = F.coalesce("snippets", none)
    used = found if limit is None else F.slice(found, F.lit(1), F.lit(limit))
    lines = F.when(F.size(used) > 0, F.array_join(F.transform(used, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(F.lit(NONE))
    per_item = hit.select("id", "place", F.concat(F.col("item"), F.lit(":\n"), lines).alias("text"), F.size(found).alias("raw"), F.size(used).alias("used"))
    return per_item.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n\n").alias("block"),
        F.sum("raw").alias("raw_count"),
        F.sum("used").alias("used_count"),
    )


def food_evidence(rows: DataFrame, evidence: DataFrame, food: str = "target_food", limit: int = 10) -> DataFrame:
    """(id, evidence_key, evidence_found, raw_count, used_count, block): the first ``limit`` snippets of the row's food."""
    hit = rows.select("id", name_text(food).alias("key")).join(small_side(checkpoint(evidence)), "key", "left")
    found = F.coalesce("snippets", F.array().cast("array<string>"))
    used = F.slice(found, F.lit(1), F.lit(limit))
    return hit.select(
        "id",
        F.col("key").alias("evidence_key"),
        F.col("snippets").isNotNull().alias("evidence_found"),
        F.size(found).cast("bigint").alias("raw_count"),
        F.size(used).cast("bigint").alias("used_count"),
        F.when(F.size(used) > 0, F.array_join(F.transform(used, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(F.lit(NONE)).alias("block"),
    )


def resolved_demos(metadata: DataFrame, train: DataFrame, k: int = 3) -> DataFrame:
    """(id, rank, demo_id, …): the first k recorded demos that are in ``train`` (demo_id, …).

    The list is cut first and looked up then, so ids that are missing shorten it.
    """
    cut = metadata.select("id", F.posexplode(F.slice("retrieved", F.lit(1), F.lit(k))).alias("at", "d")).select("id", (F.col("at") + 1).cast("bigint").alias("rank"), F.col("d.id").alias("demo_id"))
    return cut.join(train, "demo_id").select("id", "rank", "demo_id", *[c for c in train.columns if c != "demo_id"])
