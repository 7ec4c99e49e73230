"""Presence entropy of set members and selection of the most telling ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palatine.functions.normalize import entropy_key
from palatine.operators.physical import small_side


def binary_entropy(p: Column) -> Column:
    """-p ln p - (1-p) ln(1-p), 0 at both ends."""
    term = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))
    return term(p) + term(F.lit(1.0) - p)


def presence_entropy(rows: DataFrame, items: str = "molecules") -> DataFrame:
    """(item, df, entropy): over all rows, rows without items included; an item counts once per row."""
    keys = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(items), F.array().cast("array<string>")), entropy_key), lambda k: k != ""))
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = rows.select(F.explode(keys).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("item", "df", binary_entropy(F.col("df") / F.col("n")).alias("entropy"))


def lowest_entropy(rows: DataFrame, entropy: DataFrame, count: int = 10, key: str = "id", items: str = "molecules") -> DataFrame:
    """(id, place, item, entropy): the ``count`` items of lowest entropy per row, ties by position.

    Items not seen in training have entropy 0 and so come first; of items that
    differ in case only the first stays.
    """
    spread = rows.select(F.col(key).alias("id"), F.posexplode(items).alias("pos", "raw")).withColumn("item", entropy_key("raw")).where("item <> ''")
    once = spread.groupBy("id", "item").agg(F.min(F.struct("pos", "raw")).alias("m")).select("id", "item", "m.pos", "m.raw")
    scored = once.join(small_side(entropy.select("item", "entropy")), "item", "left").withColumn("entropy", F.round(F.coalesce("entropy", F.lit(0.0)), 9))
    by = Window.partitionBy("id").orderBy("entropy", "pos")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= count).select("id", F.col("place").cast("bigint").alias("place"), F.col("raw").alias("item"), "entropy")
