"""Resumable sinks for streams: each micro-batch is upserted by key, exactly once per batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palatine.sources.sinks import path_exists, upsert_table


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "ord") -> StreamingQuery:
    """Keep the latest row of each key of a stream in a parquet table at ``path``.

    A batch that is delivered again after a failure is known by its number,
    which the table carries, and leaves the table as it is.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, path):
            last = spark.read.parquet(path).agg(F.max("_batch")).first()[0]
            if last is not None and last >= number:
                return
        upsert_table(batch.withColumn("_batch", F.lit(number).cast("bigint")), path, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
