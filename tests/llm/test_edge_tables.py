"""All queries over empty tables, and over tables with null rows, repeated rows and further columns of clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from palatine.llm import queries

TABLES = (
    "mfp_tasks", "mpc_reconstructed_tasks", "food_entities", "molecules", "retrieved", "retrieval_metadata", "mfp_eval_details",
    "food_category_cache", "food_categories", "prediction_lines", "documents", "eval_passages", "name_lexicon",
)
CLASH = ("values", "cid", "set_key", "size", "bucket", "n_", "word", "pos", "h", "key", "entity", "part", "salt", "item", "record", "side", "value", "field", "_row", "_seq")


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def dirty(spark, data, tmp_path_factory):
    d = tmp_path_factory.mktemp("dirty")
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        nulls = spark.createDataFrame([()], "struct<>").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        repeated = df.unionByName(df.limit(5)).unionByName(nulls)
        repeated.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    if name == "p8_ids" and not os.path.exists(queries.bpe.tokenizer_dir()):
        pytest.skip("no tokenizer files")
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(queries.queries()) if n.endswith("_found") or n == "p8_ids"])
def test_dirty_tables(spark, data, dirty, name):
    """Null rows, repeated rows and further columns change nothing."""
    if name == "p8_ids" and not os.path.exists(queries.bpe.tokenizer_dir()):
        pytest.skip("no tokenizer files")
    run = queries.queries()[name]
    rows = lambda d: sorted(str(r) for r in set((tuple(r) if not isinstance(r[-1], list) else (r[0], tuple(r[1]))) for r in run(spark, d).collect()) if r[0] is not None)
    assert rows(dirty) == rows(data)
