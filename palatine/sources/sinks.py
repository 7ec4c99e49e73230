"""Sinks: JSON lines, one JSON document, ids, keyed upserts, caches with an identity."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def guard_output(spark: SparkSession, path: str, resume: bool = False) -> None:
    """An output that exists is an error unless the run resumes."""
    if not resume and path_exists(spark, path):
        raise FileExistsError(f"{path} exists; resume or choose another output")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line; nulls are written, other letters kept as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_ids(df: DataFrame, path: str, column: str = "id") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str) -> None:
    """The single row of ``df`` as a pretty JSON document with sorted keys, one file, replaced as a whole."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is made of exactly one row")
    _put(df.sparkSession, path, json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in the place of the old one."""
    jvm = spark.sparkContext._jvm
    at, tmp = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, str(tmp), path)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back what a replacement that died half-way has set aside."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.aside")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        if path_exists(spark, path):
            fs.delete(at, True)
        else:
            fs.rename(at, at.getParent().suffix("/" + path.rstrip("/").rsplit("/", 1)[-1]))


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put ``fresh`` in the place of ``path``: the old one is set aside first and removed last, so that one of both is always there."""
    recover(spark, path)
    jvm = spark.sparkContext._jvm
    new, at, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, f"{path}.aside"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"{path} cannot be set aside")
    if not fs.rename(new, at):
        fs.rename(aside, at)
        raise OSError(f"{fresh} cannot be moved to {path}")
    fs.delete(aside, True)


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The latest row of each key at the place where the key first appeared.

    Both sides carry ``order``, and all rows of ``new`` come after those of
    ``old`` in it.  One shuffle by key.
    """
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    by = Window.partitionBy(key)
    return (
        both.withColumn("_first", F.min(order).over(by))
        .withColumn("_rank", F.row_number().over(by.orderBy(F.desc(order))))
        .where("_rank = 1")
        .withColumn(order, F.col("_first"))
        .drop("_first", "_rank")
    )


def upsert_table(new: DataFrame, path: str, key: str = "id", order: str = "ord") -> None:
    """Upsert into a parquet table: the new version is written beside the old one, then takes its place."""
    spark = new.sparkSession
    recover(spark, path)
    old = spark.read.parquet(path) if path_exists(spark, path) else None
    if old is not None:
        shift = (old.agg(F.max(order)).first()[0] or 0) + 1
        new = new.withColumn(order, F.col(order) + F.lit(shift))
    fresh = f"{path}.{uuid.uuid4().hex}"
    upserted(old, new, key, order).write.parquet(fresh)
    replace(spark, fresh, path)


class IdentityMismatch(RuntimeError):
    """A cache was written for another judge."""


def bind_cache(spark: SparkSession, path: str, identity: dict[str, str], empty: bool) -> None:
    """Tie a cache to the judge that fills it (provider, model, address, prompt version, vocabulary digest).

    A first use writes the identity; a different one fails, as does a cache
    that has entries but no identity.
    """
    side = f"{path}.metadata.json"
    if path_exists(spark, side):
        found = json.loads(spark.read.text(side, wholetext=True).first()[0])
        if found != identity:
            raise IdentityMismatch(f"{path} belongs to {found}")
    elif not empty:
        raise IdentityMismatch(f"{path} has entries but no identity")
    else:
        _put(spark, side, json.dumps(identity, sort_keys=True, indent=2) + "\n")


def write_cache(old: DataFrame | None, new: DataFrame, path: str, key: str) -> None:
    """The cache with new entries, sorted by key, once per batch; entries of ``new`` win."""
    kept = new if old is None else new.unionByName(old.join(new.select(key), key, "left_anti"))
    fresh = f"{path}.{uuid.uuid4().hex}"  # ``old`` is read from ``path`` while this is written
    kept.sort(key).write.parquet(fresh)
    replace(new.sparkSession, fresh, path)


def status_line(label: str, status: str, payload: dict) -> str:
    """``LABEL: STATUS`` and the payload as sorted JSON."""
    return f"{label}: {status}\n{json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True)}"
