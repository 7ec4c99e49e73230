"""Duplicates hidden by formatting, kept in an incremental ledger of canonical keys.

A record's canonical key is a digest of its name keys, field by field in the
order of the field names, so that white space, letter case, punctuation and
field order vanish.  Each batch is aggregated to one row per key (partial sums
before the shuffle), full-outer-joined with the ledger of the matching buckets,
counts are added and the earliest representative stays.

Lines are parsed by built-in functions; only those that the built-in parser does
not take (broken lines, objects that give a field twice) go through Python's.

Defined cases: lines that are no JSON object are no records; of a field given
twice the last counts; null values differ from empty texts; values that are no
texts are compared by their JSON form; a null field of a columnar record equals
only null; repeated rows of one record key count once.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palatine.llm.common import checkpoint, hot_split_join, name_key

BUCKETS = 16


def _canonical(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        record = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    parts = []
    for field in sorted(record):
        value = record[field]
        if value is None:
            key = "\x02"
        else:
            text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
            key = "".join(filter(str.isalnum, text.lower()))
        parts.append(f"{field}\x1e{key}")
    return "\x1f".join(parts).encode("utf-8", "surrogatepass").decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical form of a line holding one JSON object, else null, by Python's strict parser."""
    for raw in batches:
        yield raw.map(_canonical).astype(object)


def canonical_object(raw: str) -> Column:
    """The same by built-in functions; null also where an object gives a field twice.

    The built-in parser ignores what follows a value, so the line must also be
    the only item of an array and the last value of an object.
    """
    c = F.col(raw)
    item = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    alone = F.try_variant_get(item, "$[0]", "variant").isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull()
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    fields = F.array_sort(F.map_entries(F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"})))
    parts = F.transform(fields, lambda e: F.concat(e["key"], F.lit("\u001e"), F.coalesce(name_key(e["value"]), F.lit("\u0002"))))
    return F.when(alone & closed & F.regexp_like(c, F.lit(r"^\s*\{")), F.array_join(parts, "\u001f"))


def canonical_lines(lines: DataFrame, raw: str) -> DataFrame:
    """``lines`` with ``_c``, the canonical form of their JSON object or null; each line is parsed once."""
    parsed = checkpoint(lines.withColumn("_c", canonical_object(raw)))
    rest = parsed.where(F.col("_c").isNull() & F.col(raw).isNotNull()).withColumn("_c", canonical_json(raw))
    return parsed.where(F.col("_c").isNotNull()).unionByName(rest)


def canonical_columns(*cols: str) -> Column:
    """Canonical form of columnar fields: name keys in the given order."""
    return F.concat_ws("\u001f", *[F.coalesce(name_key(c), F.lit("\u0002")) for c in cols])


def keyed(records: DataFrame, kind: str, key: str, canonical: Column, buckets: int = BUCKETS, batch: Column | None = None) -> DataFrame:
    """(kind, bucket, ckey, key, batch) of the records that have a canonical form; a record given in several batches belongs to the first."""
    return (
        records.select(F.col(key).alias("key"), canonical.alias("_c"), (F.lit(1) if batch is None else batch).alias("batch"))
        .where("key is not null and _c is not null")
        .select(F.lit(kind).alias("kind"), F.unhex(F.md5(F.concat(F.lit(kind + "\u001d"), "_c"))).alias("ckey"), "key", "batch")
        .groupBy("kind", "ckey", "key")
        .agg(F.min("batch").alias("batch"))
        .select("kind", F.pmod(F.xxhash64("ckey"), F.lit(buckets)).cast("int").alias("bucket"), "ckey", "key", "batch")
    )


def arrival(rows: DataFrame, at: str, parts: int) -> Column:
    """Batch number 1 to ``parts`` of a row by its time of arrival ``at``; rows without a time come in the first."""
    ends = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    return F.lit(1) + sum((F.coalesce(F.col(at) > F.lit(e), F.lit(False)).cast("int") for e in ends), F.lit(0))


def batch_counts(members: DataFrame) -> DataFrame:
    """(bucket, ckey, kind, copies, first_key) of one batch."""
    return members.groupBy("bucket", "ckey").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key"))


def merge_ledger(ledger: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The ledger with a batch of counts added; co-partitioned by (bucket, ckey)."""
    if ledger is None:
        return batch
    new = batch.select("bucket", "ckey", *[F.col(c).alias(f"_{c}") for c in ("kind", "copies", "first_key")])
    return ledger.join(new, ["bucket", "ckey"], "full_outer").select(
        "bucket",
        "ckey",
        F.coalesce("kind", "_kind").alias("kind"),
        (F.coalesce("copies", F.lit(0)) + F.coalesce("_copies", F.lit(0))).alias("copies"),
        F.least("first_key", "_first_key").alias("first_key"),
    )


LEDGER = "bucket int, ckey binary, kind string, copies bigint, first_key string"


class KeyLedger:
    """A ledger stored as parquet, one folder per bucket and version; an update rewrites the buckets its batch touches.

    New versions are written beside the old ones; then a pointer file of the
    next number is moved into place, which is one step, and the newest pointer
    counts.  A failed update therefore leaves the ledger as it was.  A pointer
    holds the number of the last batch; a batch delivered again is left out.
    Folders that neither of the two newest pointers names are removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name) if name else self.path)

    def _names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def _pointer(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> dict:
        """batch: number of the last batch; buckets: bucket to the folder that holds its rows."""
        pointers = [n for n in self._names() if n.startswith("pointer-")]
        return self._pointer(pointers[-1]) if pointers else {"batch": 0, "buckets": {}}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        found = [os.path.join(self.path, v) for k, v in self.current()["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(LEDGER).parquet(*found) if found else self.spark.createDataFrame([], LEDGER)

    def update(self, counts: DataFrame, number: int | None = None) -> bool:
        """Add the counts of batch ``number`` (the next one, if not given); whether it was new."""
        now = self.current()
        number = now["batch"] + 1 if number is None else number
        if number <= now["batch"]:
            return False
        counts = checkpoint(counts)
        touched = [r[0] for r in counts.select("bucket").distinct().collect()]  # at most as many as there are buckets
        version = f"v-{uuid.uuid4().hex}"
        if touched:
            merged = merge_ledger(self.read(touched), counts)
            merged.withColumn("b", F.col("bucket")).repartition("bucket").write.partitionBy("b").parquet(os.path.join(self.path, version))
        buckets = now["buckets"] | {str(b): f"{version}/b={b}" for b in touched}
        pointer = f"pointer-{number:012d}.json"
        tmp = self._at(f"tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"batch": number, "buckets": buckets}).encode()))
        out.close()
        if not self._fs.rename(tmp, self._at(pointer)):
            raise RuntimeError(f"{pointer} is there already: another update was faster")
        self._clean()
        return True

    def _clean(self) -> None:
        names = self._names()
        pointers = [n for n in names if n.startswith("pointer-")]
        kept = {v.split("/")[0] for p in pointers[-2:] for v in self._pointer(p)["buckets"].values()} | set(pointers[-2:])
        for n in names:
            if n.startswith(("v-", "pointer-")) and n not in kept:
                self._fs.delete(self._at(n), True)


def copies(members: DataFrame, ledger: DataFrame) -> DataFrame:
    """(first_key, copy_key): every record but the first of its group."""
    groups = ledger.where("copies > 1").select("ckey", "copies", "first_key")
    return hot_split_join(members.select("ckey", "key"), groups, "ckey", "copies").where("key <> first_key").select("first_key", F.col("key").alias("copy_key"))
