"""Queries of the training-data operators over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.llm import bpe, canonical_map, cooccur, cross_split, format_dups, group_split, leak_automaton, pii_crf, set_similarity, topn
from palatine.llm.common import checkpoint, current_rows, food_index, name_key, new_folder, small_side, split_key, table, value_set

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def _molecule_sets(spark: SparkSession, d: str) -> DataFrame:
    mfp = current_rows(table(spark, d, "mfp_tasks"), "molecules").select("id", value_set("molecules").alias("values"))
    both = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("partial_molecules", "missing_molecules")])
    mpc = current_rows(table(spark, d, "mpc_reconstructed_tasks"), "partial_molecules", "missing_molecules").select("id", value_set(both).alias("values"))
    return mfp.unionByName(mpc)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return set_similarity.similar_set_pairs(_molecule_sets(spark, d), 7, 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieved").select("id", F.col("cand_id").alias("item"), "seq", "score")
    limits = table(spark, d, "retrieval_metadata").select("id", F.col("top_k").alias("n"))
    return topn.top_n_per_group(rows, limits).select("id", "place", F.col("item").alias("cand_id"))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    split = split_key("split")
    side = F.when(split == "train", "train").when(split.isin("dev", "test"), "eval")
    return current_rows(table(spark, d, "mfp_tasks"), "molecules", "split").select("id", value_set("molecules").alias("values"), side.alias("side"))


def _p3_rows(spark: SparkSession, d: str) -> DataFrame:
    near = cross_split.cross_split_pairs(_sides(spark, d), 9, 10).select(F.lit("molecules").alias("kind"), F.col("id_eval").alias("id"), F.col("id_train").alias("other"))
    tasks = current_rows(table(spark, d, "mfp_tasks"), "actual_food")
    food = cross_split.same_food_demos(table(spark, d, "retrieval_metadata"), tasks, food_index(table(spark, d, "food_entities")))
    return near.unionByName(food.select(F.lit("food").alias("kind"), "id", F.col("demo_id").alias("other")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_rows(spark, d).select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per split and source of the evaluation record or query."""
    own = current_rows(table(spark, d, "mfp_tasks"), "split", "source").select("id", split_key("split").alias("split"), "source")
    return (
        _p3_rows(spark, d)
        .join(own, "id", "left")
        .groupBy("kind", "split", "source")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("id").alias("n_records"))
    )


#: Batches in which the prediction lines arrive; the cache is one more.
LINE_BATCHES = 3


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, ledger): lines batch by batch in the order of their arrival, then the cache, through a ledger on disk."""
    raw = table(spark, d, "prediction_lines").select("line_key", "raw", "received_at")
    lines = format_dups.keyed(format_dups.canonical_lines(raw, "raw"), "line", "line_key", F.col("_c"), batch=format_dups.arrival(raw, "received_at", LINE_BATCHES))
    cache = format_dups.keyed(table(spark, d, "food_category_cache"), "cache", "entry_key", format_dups.canonical_columns("food_key", "category"), batch=F.lit(LINE_BATCHES + 1))
    members = checkpoint(lines.unionByName(cache))
    ledger = format_dups.KeyLedger(spark, new_folder(spark, "ledger"))
    for k in range(1, LINE_BATCHES + 2):
        ledger.update(format_dups.batch_counts(members.where(F.col("batch") == k)), k)
    return members, ledger.read()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.copies(*_p4(spark, d))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return _p4(spark, d)[1].select("kind", "first_key", "copies")


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    mfp = current_rows(table(spark, d, "mfp_tasks"), "molecules").select(value_set("molecules").alias("items"))
    mpc = current_rows(table(spark, d, "mpc_reconstructed_tasks"), "missing_molecules").select(value_set("missing_molecules").alias("items"))
    return mfp.unionByName(mpc)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.significant(cooccur.cooccurrence(_baskets(spark, d), min_count=5, min_share_ppm=2000))
    return pairs.where("n_ab * n >= 3 * n_a * n_b").select(F.col("item_a").alias("molecule_a"), F.col("item_b").alias("molecule_b"))


def _p5_counts(spark: SparkSession, d: str, min_count: int) -> DataFrame:
    pairs = cooccur.cooccurrence(_baskets(spark, d), min_count=min_count)
    return pairs.select(F.col("item_a").alias("molecule_a"), F.col("item_b").alias("molecule_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p5_llr(spark: SparkSession, d: str) -> DataFrame:
    """Counts, lift and log-likelihood ratio of the pairs that occur five times or more."""
    return _p5_counts(spark, d, 5)


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Counts, lift and log-likelihood ratio of every pair that occurs."""
    return _p5_counts(spark, d, 1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    details, foods, cats = (table(spark, d, n) for n in ("mfp_eval_details", "food_entities", "food_categories"))
    cell = lambda c: spark.sql(f"SELECT detail_id, {c} AS value FROM {{details}}", details=details)
    food = canonical_map.map_column(cell("predicted_food"), spark.sql(canonical_map.ENTITY_NAMES, entities=foods), spark.sql("SELECT entity_alias_readable AS value FROM {foods}", foods=foods))
    kind = canonical_map.map_column(cell("predicted_category"), spark.sql("SELECT category AS name, category_id AS canon_id FROM {cats}", cats=cats), spark.sql("SELECT category AS value FROM {cats}", cats=cats))
    return spark.sql("SELECT detail_id, 'predicted_food' AS field, canon_id FROM {food} UNION ALL SELECT detail_id, 'predicted_category', canon_id FROM {kind}", food=food, kind=kind)


def _food_records(spark: SparkSession, d: str) -> DataFrame:
    mfp = current_rows(table(spark, d, "mfp_tasks"), "actual_food", "split").select(F.concat(F.lit("mfp:"), "id").alias("record"), F.col("actual_food").alias("food"), split_key("split").alias("split"))
    mpc = current_rows(table(spark, d, "mpc_reconstructed_tasks"), "target_food", "split").select(F.concat(F.lit("mpc:"), "id").alias("record"), F.col("target_food").alias("food"), split_key("split").alias("split"))
    index = small_side(food_index(table(spark, d, "food_entities")))
    return mfp.unionByName(mpc).withColumn("food_name", name_key("food")).join(index, "food_name", "left").select("record", F.col("entity_id").alias("entity"), "split")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    records = _food_records(spark, d)
    grouped = group_split.group_records(records.select("record", "entity"))
    return group_split.split_breakers(grouped, records.select("record", "split")).select(F.col("entity").alias("entity_id"))


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split every task is assigned to."""
    return group_split.split_records(_food_records(spark, d).select("record", "entity"), SHARES).select("record", "split")


def _ranks() -> dict[bytes, int]:
    return bpe.load_ranks(f"{bpe.tokenizer_dir()}/byte_bpe_50k.tiktoken")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents").select("doc_id", "text"), _ranks())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_automaton.leaked_items(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_passages")).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages of evaluation items; those of which more than half is leaked are emptied."""
    out = leak_automaton.remove_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_passages"))
    return out.select("doc_id", "text", F.col("removed_words").cast("bigint").alias("removed_words"), "dropped")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return pii_crf.mentions(texts, pii_crf.train_field(texts, table(spark, d, "name_lexicon")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its mentions replaced by placeholders."""
    texts = _texts(spark, d)
    return pii_crf.redact(texts, pii_crf.train_field(texts, table(spark, d, "name_lexicon")))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
        "p4_collapsed": p4_collapsed,
        "p5_found": p5_found,
        "p5_llr": p5_llr,
        "p5_pairs": p5_pairs,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_splits": p7_splits,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p9_cleaned": p9_cleaned,
        "p10_found": p10_found,
        "p10_redacted": p10_redacted,
    }
