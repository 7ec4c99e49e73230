"""Row splits: the exact seeded shuffle, and a hash order for tables of any size."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palatine.operators.physical import checkpoint

NAMES = ("train", "dev", "test")
#: Rows up to which the exact permutation is made; it is held by the driver.
SEEDED_ROWS = 5_000_000


def split_sizes(total: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> tuple[int, ...]:
    """Sizes by largest remainder; equal remainders go to the earlier part."""
    if abs(math.fsum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    exact = [total * r for r in ratios]
    sizes = [math.floor(x) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: (sizes[i] - exact[i], i))[: total - sum(sizes)]:
        sizes[i] += 1
    return tuple(sizes)


def seeded_order(total: int, seed: int = 42) -> list[int]:
    """Row ordinals in the order of a seeded shuffle of the whole table."""
    order = list(range(total))
    random.Random(seed).shuffle(order)
    return order


def seeded_split(rows: DataFrame, ordinal: str, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``rows`` with (split, split_pos), shuffled from the order of ``ordinal``; for at most SEEDED_ROWS rows."""
    rows, total = numbered(rows, "_ordinal", ordinal)  # dense, whatever the gaps
    if total > SEEDED_ROWS:
        raise ValueError(f"{total} rows: use hash_split beyond {SEEDED_ROWS}")
    spark = rows.sparkSession
    place = [0] * total
    for p, o in enumerate(seeded_order(total, seed)):
        place[o] = p
    import pandas as pd

    plan = spark.createDataFrame(pd.DataFrame({"_o": range(total), "split_pos": place}), "_o bigint, split_pos bigint")
    return _named(rows.join(plan, F.col("_ordinal") == F.col("_o")).drop("_o", "_ordinal"), split_sizes(total, ratios))


def _named(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    name = F.when(F.col("split_pos") < ends[0], NAMES[0]).when(F.col("split_pos") < ends[1], NAMES[1]).otherwise(NAMES[2])
    return rows.withColumn("split", name)


def hash_split(rows: DataFrame, key: str, seed: str = "42", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``rows`` with (split, split_pos): exact sizes in the order of sha256(seed | key), ties by key.

    The position is that of a distributed numbering.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    placed, total = numbered(rows.withColumn("_h", digest), "split_pos", "_h", key)
    return _named(placed.drop("_h"), split_sizes(total, ratios))


def numbered(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with the dense number ``name`` from 0 in ``order``, and their count.

    Distributed: rows are range-partitioned, numbered within the partition and
    shifted by the number of rows before it.
    """
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = checkpoint(sizes.select("_p", before.alias("_before"), "_n"))
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(F.broadcast(offsets.drop("_n")), "_p").withColumn(name, F.col("_at") + F.col("_before")).drop("_p", "_at", "_before"), total
