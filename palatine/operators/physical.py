"""Physical helpers: checked broadcasts, reliable checkpoints, current rows."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` in all; reads no more than one row beyond."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))) if any(t.startswith(("string", "array", "struct", "map", "binary")) for _, t in df.dtypes) else F.lit(0)
    n = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return n["rows"] <= max_rows and n["bytes"] <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is: the join then shuffles.

    A ``df`` that is costly to compute is to be checkpointed first, since the
    check and the join both read it.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the session names; a temporary one only where none is named."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"palatine-checkpoints-{os.getpid()}"))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the folder the session names, removed when the process ends; the shuffle files of its making go at once.

    Unlike a checkpoint, later reads take only the columns they need.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(shared or os.path.join(tempfile.gettempdir(), f"palatine-checkpoints-{os.getpid()}"), f"kept-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, path)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over
        pass


def latest(df: DataFrame, *cols: str, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The row with the largest ``order`` of each non-null ``key``; one shuffle of the columns asked for."""
    payload = F.struct(*[F.col(c) for c in cols])
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max_by(payload, order).alias("_r")).select("id", *[F.col(f"_r.`{c}`").alias(c) for c in cols])


def spread(df: DataFrame) -> DataFrame:
    """A file scan of few splits over all cores, for stages whose work is heavy for their bytes; large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
