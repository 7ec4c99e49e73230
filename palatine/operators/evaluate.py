"""Scoring of predictions against gold rows with a memoised judge's lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palatine.functions.normalize import compact_text, surface_text
from palatine.operators.physical import small_side

EPSILON = 1e-9
EMPTY = "array<string>"


def set_metrics(predicted: Column, gold: Column) -> Column:
    """struct<precision, recall, f1, iou> of two distinct arrays.

    Both empty: all 1.  Precision divides by the number of predictions plus
    1e-9; recall and IoU are 0 where their divisor is.
    """
    both = F.size(F.array_intersect(predicted, gold)).cast("double")
    p = both / (F.size(predicted) + F.lit(EPSILON))
    r = F.when(F.size(gold) > 0, both / F.size(gold)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    union = F.size(F.array_union(predicted, gold))
    iou = F.when(union > 0, both / union).otherwise(F.lit(0.0))
    none = (F.size(predicted) == 0) & (F.size(gold) == 0)
    pick = lambda x: F.when(none, F.lit(1.0)).otherwise(x)
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(f1).alias("f1"), pick(iou).alias("iou"))


def distinct_surface(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(key, surface): each distinct surface text with its last spelling; empty keys are dropped."""
    return rows.where(F.col(column).isNotNull()).select(surface_text(column).alias("key"), F.col(column).alias("_s"), F.col(order).alias("_o")).where("key <> ''").groupBy("key").agg(F.max_by("_s", "_o").alias("surface"))


def cache_misses(keys: DataFrame, cache: DataFrame, cache_key: str) -> DataFrame:
    """Keys the judge has to be asked for."""
    return keys.join(small_side(cache.select(F.col(cache_key).alias("key")).distinct()), "key", "left_anti")


def cache_hits(keys: DataFrame, cache: DataFrame, cache_key: str) -> DataFrame:
    return keys.join(small_side(cache.withColumnRenamed(cache_key, "key")), "key")


def match_predictions(gold: DataFrame, predictions: DataFrame, failed: DataFrame) -> DataFrame:
    """``gold`` with the prediction columns and match_status: matched, parse_failed or missing_prediction.

    Ids are compared as text; a null gold id meets nothing.
    """
    g = gold.withColumn("id", F.col("id").cast("string"))
    got = predictions.withColumn("_hit", F.lit(True))
    bad = failed.select("id").distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("_hit"), "matched").when(F.col("_bad"), "parse_failed").otherwise("missing_prediction")
    return g.join(got, "id", "left").join(bad, "id", "left").withColumn("match_status", status).drop("_hit", "_bad")


def extra_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions whose id is no gold id."""
    return predictions.join(gold.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti")


def food_details(gold: DataFrame, predictions: DataFrame, failed: DataFrame, categories: DataFrame, cache: DataFrame) -> DataFrame:
    """One detail row per gold row of a food task.

    ``gold`` (id, actual_food), ``predictions`` (id, predicted_food),
    ``categories`` (food, category) by exact spelling, ``cache`` (food,
    category) by surface text.
    """
    rows = match_predictions(gold.select("id", "actual_food"), predictions.select("id", "predicted_food"), failed)
    truth = small_side(categories.select(F.col("food").alias("actual_food"), F.col("category").alias("_gold")))
    judged = small_side(cache.select(F.col("food").alias("_key"), F.col("category").alias("_judged")))
    rows = rows.join(truth, "actual_food", "left").withColumn("_key", F.when(F.col("predicted_food").isNotNull(), surface_text("predicted_food"))).join(judged, "_key", "left")
    matched = F.col("match_status") == "matched"
    has_gold = F.coalesce(F.col("_gold"), F.lit("")) != ""
    why = (
        F.when(~matched, F.col("match_status"))
        .when(~has_gold, "gold_category_lookup_failed")
        .when(F.col("_judged").isNull(), "llm_mapping_failed")
    )
    return rows.select(
        "id",
        "actual_food",
        "predicted_food",
        F.when(matched & has_gold, F.col("_gold")).alias("gold_category"),
        F.when(matched & has_gold, F.col("_judged")).alias("predicted_category"),
        F.coalesce(matched & has_gold & (compact_text("_judged") == compact_text("_gold")) & F.col("_judged").isNotNull(), F.lit(False)).alias("correct"),
        F.coalesce(why == "parse_failed", F.lit(False)).alias("parse_failed"),
        F.coalesce(why == "llm_mapping_failed", F.lit(False)).alias("llm_mapping_failed"),
        F.coalesce(why == "gold_category_lookup_failed", F.lit(False)).alias("gold_category_lookup_failed"),
        F.coalesce(why == "missing_prediction", F.lit(False)).alias("missing_prediction"),
        why.alias("failure_reason"),
    )


def food_summary(details: DataFrame) -> DataFrame:
    """One row of counts and the accuracy over all gold rows."""
    flags = ("correct", "parse_failed", "llm_mapping_failed", "gold_category_lookup_failed", "missing_prediction")
    n = F.count(F.lit(1))
    return details.agg(
        n.alias("total_gold"),
        F.count_if(~F.col("parse_failed") & ~F.col("missing_prediction")).alias("matched_ids"),
        *[F.count_if(F.col(f)).alias(f) for f in flags],
        F.count_distinct(F.when(F.col("predicted_food").isNotNull(), surface_text("predicted_food"))).alias("unique_predicted_foods"),
        F.when(n > 0, F.count_if("correct") / n).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def group_union(rows: DataFrame, items: str, groups: DataFrame) -> DataFrame:
    """(id, groups, unmapped): the union of the groups of a row's items, and the items without any entry, with repeats.

    Rows without items are kept with empty results.
    """
    spread = rows.select("id", F.posexplode_outer(items).alias("_p", "_i")).withColumn("molecule", F.when(F.col("_i").isNotNull(), surface_text("_i")))
    known = small_side(groups.select("molecule", "groups"))
    hit = spread.join(known, "molecule", "left")
    lost = F.when(F.col("_p").isNotNull() & F.col("groups").isNull(), F.struct("_p", "_i"))
    return hit.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"),
        F.transform(F.array_sort(F.collect_list(lost)), lambda s: s["_i"]).alias("unmapped"),
    )


def molecule_details(gold: DataFrame, predictions: DataFrame, failed: DataFrame, truth: DataFrame, cache: DataFrame) -> DataFrame:
    """One detail row per gold row of a completion task.

    ``gold`` (id, target_food, n, missing_molecules) with distinct ids,
    ``truth`` and ``cache`` (molecule, groups).  Rows without a usable
    prediction score 0 in all metrics.
    """
    rows = match_predictions(gold.select("id", "target_food", "n", "missing_molecules"), predictions.select("id", "predicted_molecules"), failed)
    want = group_union(rows.select("id", "missing_molecules"), "missing_molecules", truth)
    have = group_union(rows.select("id", "predicted_molecules"), "predicted_molecules", cache)
    rows = rows.join(want.select("id", F.col("groups").alias("_want"), F.size("unmapped").alias("_lost")), "id", "left").join(have.select("id", F.col("groups").alias("_have"), F.col("unmapped").alias("_unmapped")), "id", "left")
    matched = F.col("match_status") == "matched"
    none = F.array().cast(EMPTY)
    of = lambda c: F.when(matched, F.coalesce(F.col(c), none)).otherwise(none)
    m = set_metrics(of("_have"), of("_want"))
    count = F.size(F.coalesce("predicted_molecules", none))
    zero = F.lit(0.0)
    return rows.select(
        "id",
        "target_food",
        "n",
        "missing_molecules",
        F.coalesce("predicted_molecules", none).alias("predicted_molecules"),
        count.cast("bigint").alias("predicted_molecule_count"),
        F.when(F.col("n").isNotNull(), count == F.col("n")).alias("predicted_count_equals_n"),
        F.size("missing_molecules").cast("bigint").alias("gold_missing_molecule_count"),
        of("_want").alias("gold_functional_groups"),
        of("_have").alias("predicted_functional_groups"),
        F.array_sort(F.array_intersect(of("_have"), of("_want"))).alias("overlap_functional_groups"),
        *[F.when(matched, m[k]).otherwise(zero).alias(k) for k in ("precision", "recall", "f1", "iou")],
        (F.col("match_status") == "parse_failed").alias("parse_failed"),
        (F.col("match_status") == "missing_prediction").alias("missing_prediction"),
        F.when(matched, F.coalesce("_lost", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("gold_group_lookup_failures"),
        of("_unmapped").alias("unmapped_predicted_molecules"),
        F.when(~matched, F.col("match_status")).alias("failure_reason"),
    )


def molecule_summary(details: DataFrame) -> DataFrame:
    """One row of counts and macro averages over all gold rows."""
    matched = ~F.col("parse_failed") & ~F.col("missing_prediction")
    avg = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"average_{c}")
    total = details.agg(
        F.count(F.lit(1)).alias("total_gold"),
        F.count_if(matched).alias("matched_ids"),
        F.count_if("parse_failed").alias("parse_failed"),
        F.count_if("missing_prediction").alias("missing_prediction"),
        F.count_if(matched & (F.col("f1") == 0)).alias("zero_f1_count"),
        F.count_if(F.col("predicted_count_equals_n") == F.lit(False)).alias("predicted_count_not_equal_n"),
        F.coalesce(F.sum("gold_group_lookup_failures"), F.lit(0)).alias("gold_group_lookup_failures"),
        F.coalesce(F.sum(F.size("unmapped_predicted_molecules")), F.lit(0)).cast("bigint").alias("unmapped_predicted_molecules"),
        *[avg(c) for c in ("precision", "recall", "f1", "iou")],
    )
    unique = details.select(F.explode("unmapped_predicted_molecules").alias("m")).agg(F.count_distinct(surface_text("m")).alias("unique_unmapped_predicted_molecules"))
    return total.crossJoin(F.broadcast(unique))
