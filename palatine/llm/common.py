"""Keys, current rows and physical helpers shared by the training-data operators.

Two text keys are used everywhere.  The *name key* of a text is its lower-cased
letters and digits with nothing in between; the *value key* is the lower-cased
text in which every run of other characters is one blank, trimmed.  Both are
built-in column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"


def name_key(c: Column | str) -> Column:
    """Lower case, only letters and digits kept; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def value_key(c: Column | str) -> Column:
    """Lower case, other runs become one blank, trimmed; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), NOT_ALNUM, " "))


def value_set(c: Column | str) -> Column:
    """Sorted distinct value keys of an array; null arrays and null or empty values give nothing."""
    c = F.col(c) if isinstance(c, str) else c
    keys = F.transform(F.coalesce(c, F.array().cast("array<string>")), value_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != ""))))


def split_key(c: Column | str) -> Column:
    """A split name without letter case and outer blanks; blank names are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def current_rows(df: DataFrame, *cols: str, key: str = "id", seq: str = "ingest_seq") -> DataFrame:
    """The row with the largest ``seq`` of each ``key``; null keys are left out.

    One shuffle of (key, payload).  Rows of a key that tie on ``seq`` (a row
    delivered twice) give one row.
    """
    payload = F.struct(F.col(seq).alias("_seq"), *[F.col(c) for c in cols])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max_by(payload, F.col(seq)).alias("_row"))
        .select("id", *[F.col(f"_row.`{c}`").alias(c) for c in cols])
    )


def synonym_parts(c: Column | str) -> Column:
    """The parts of a synonym list separated by ``;``, ``,`` or ``|``."""
    return F.split(c, r"[;,|]")


def food_index(foods: DataFrame) -> DataFrame:
    """(food_name, entity_id): every name key of a food, from its readable alias and its synonyms.

    A key that several foods carry goes to the smallest entity_id, so that a
    text has one food at most.
    """
    parts = F.concat(
        F.array(F.col("entity_alias_readable")),
        F.coalesce(synonym_parts("entity_alias_synonyms"), F.array().cast("array<string>")),
    )
    return (
        foods.select("entity_id", F.explode(parts).alias("_n"))
        .select(F.col("entity_id").cast("bigint").alias("entity_id"), name_key("_n").alias("food_name"))
        .where(F.col("food_name").isNotNull() & (F.col("food_name") != "") & F.col("entity_id").isNotNull())
        .groupBy("food_name")
        .agg(F.min("entity_id").alias("entity_id"))
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``; only where none is set (tests on one machine) a temporary one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or os.path.join(tempfile.gettempdir(), f"palatine-checkpoints-{os.getpid()}")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one, removed when the session's process ends."""
    path = os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over
        pass


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder.

    Unlike a checkpoint of rows it is compressed, and later reads take only
    the columns they need.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within are removed as soon as an action ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_parts(spark: SparkSession, parts: int, make: Callable[[int], DataFrame]) -> tuple[DataFrame, str]:
    """The union of ``make(0)`` … ``make(parts - 1)`` as one table and its folder, written one after another: the disk holds the shuffle of one part only."""
    path = new_folder(spark, "table")
    with cleaned(spark):
        for i in range(parts):
            part = make(i)
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(part.schema).parquet(path), path


def of_part(key: str, i: int, parts: int) -> Column:
    """Whether a row's ``key`` belongs to part ``i``; all do if there is but one."""
    return F.pmod(F.xxhash64(key), F.lit(parts)) == i if parts > 1 else F.lit(True)


#: Rows up to which a reference side may be broadcast, and hot keys by share.
BROADCAST_ROWS = 200_000
HOT_SHARE = 1000


def small_is(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if small_is(df, max_rows) else df


def hot_split_join(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many ``rows`` with one row per ``key`` in ``groups``, safe for hot keys.

    ``groups[n]`` is the number of rows of each key.  Keys that hold at least
    1/1000 of the rows number at most 1000, whatever the data: they are
    broadcast, so their rows never move.  All others are shuffled, and no group
    of them holds more than a thousandth of the rows.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    bar = max(1, total // HOT_SHARE)
    hot, cold = groups.where(F.col(n) > bar), groups.where(F.col(n) <= bar)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A file scan of few splits over all cores, for stages whose work is heavy for their bytes; large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
