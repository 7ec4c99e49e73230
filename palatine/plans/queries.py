"""Queries of the data-preparation, retrieval and scoring operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.functions import normalize as N
from palatine.functions import parse as G
from palatine.operators import entropy, evaluate, evidence, model, pipeline, profile, prompts, resolve, retrieval, split, validate
from palatine.operators.physical import latest
from palatine.sources import jsonl, sinks, tables

SEP = " | "


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def food_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(t(spark, d, "mfp_tasks"), "actual_food", "molecules", "split")
    return rows.withColumn("split", F.lower(N.strip("split")))


def completion_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(t(spark, d, "mpc_reconstructed_tasks"), "target_food", "partial_molecules", "n", "missing_molecules", "split")
    return rows.withColumn("split", F.lower(N.strip("split")))


def _listed(c) -> F.Column:
    return F.array_join(c, SEP, "null")


# -- normalisation and tokens


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    tok = N.tokens("text")
    return t(spark, d, "documents").select("doc_id", F.size(tok).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tok)).cast("bigint").alias("n_distinct"))


def normalize_forms(spark: SparkSession, d: str) -> DataFrame:
    c = "predicted_food"
    return t(spark, d, "mfp_eval_details").select("detail_id", N.name_text(c).alias("name_form"), N.surface_text(c).alias("surface_form"), N.compact_text(c).alias("compact_form"), N.entropy_key(c).alias("entropy_form"), N.clean_prediction(c).alias("clean_form"))


def synonym_split(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "food_entities").select("entity_id", F.posexplode(N.synonym_parts("entity_alias_synonyms")).alias("pos", "part")).select("entity_id", F.col("pos").cast("bigint").alias("pos"), "part")


def functional_group_sets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "molecules").select("id", _listed(F.array_sort(N.functional_groups("functional_groups"))).alias("groups"), F.size(N.functional_groups("functional_groups")).cast("bigint").alias("n_groups"))


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    stats = retrieval.corpus_stats(docs)
    return retrieval.document_frequency(docs).crossJoin(F.broadcast(stats)).select("token", "df", F.round(retrieval.idf(F.col("n"), F.col("df").cast("double")), 6).alias("idf"))


# -- retrieval


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "eval_passages").select(F.col("item_id").alias("query_id"), "text")


def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(t(spark, d, "documents").select("doc_id", "text"), _passages(spark, d), 3)


def bm25_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    queries = t(spark, d, "food_categories").select(F.col("category_id").alias("query_id"), F.col("category").alias("text"))
    return retrieval.bm25_top_k(t(spark, d, "documents").select("doc_id", "text"), queries, 3)


def _task_corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = food_tasks(spark, d)
    docs = tasks.where("split = 'train'").select(F.col("id").alias("doc_id"), retrieval.food_document("actual_food", "molecules").alias("text"))
    return docs, tasks.where("split = 'test'").select(F.col("id").alias("query_id"), retrieval.molecule_text("molecules").alias("text"))


def bm25_tasks_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(*_task_corpus(spark, d), 3)


def bm25_completion_top3(spark: SparkSession, d: str) -> DataFrame:
    tasks = completion_tasks(spark, d)
    docs = tasks.where("split = 'train'").select(F.col("id").alias("doc_id"), retrieval.completion_document("target_food", "partial_molecules", "missing_molecules").alias("text"))
    queries = tasks.where("split = 'test'").select(F.col("id").alias("query_id"), retrieval.completion_query("target_food", "partial_molecules").alias("text"))
    return retrieval.bm25_top_k(docs, queries, 3)


def retrieval_packed(spark: SparkSession, d: str) -> DataFrame:
    one = lambda r: F.concat(r["rank"].cast("string"), F.lit(":"), r["doc_id"].cast("string"))
    return retrieval.packed(bm25_top3(spark, d)).select("query_id", F.array_join(F.transform("retrieved", one), ",").alias("retrieved"))


def demo_resolution(spark: SparkSession, d: str) -> DataFrame:
    train = food_tasks(spark, d).where("split = 'train'").select(F.col("id").alias("demo_id"), "actual_food")
    return evidence.resolved_demos(t(spark, d, "retrieval_metadata").select("id", "retrieved"), train, 3)


def retrieval_gaps(spark: SparkSession, d: str) -> DataFrame:
    ids = food_tasks(spark, d).where("split = 'test'").select("id")
    return validate.incomplete_retrieval(ids, t(spark, d, "retrieval_metadata"), 3).select("id", F.col("found").cast("bigint").alias("found"))


# -- preparation


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.resolve_names(food_tasks(spark, d).select("id", "actual_food"), resolve.name_index(t(spark, d, "food_entities")), "actual_food")
    return found.select("id", "match_status", "entity_id", F.size("candidates").cast("bigint").alias("n_candidates"))


def name_resolution_status(spark: SparkSession, d: str) -> DataFrame:
    return resolve.status_histogram(name_resolution(spark, d), "match_status")


def _full(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("molecule_id"))
    return resolve.full_sets(links, t(spark, d, "part").select(F.col("p_partkey").alias("molecule_id"), F.col("p_name").alias("common_name")))


def full_set(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).select("entity_id", _listed("full").alias("full_items"), F.size("full").cast("bigint").alias("n_full"))


def reconstructed(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    gone = t(spark, d, "lineitem").where("l_returnflag = 'R'").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.collect_list("p_name").alias("missing"))
    tasks = t(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("food"), F.lit("matched_unique").alias("match_status")).join(gone, "entity_id", "left")
    return resolve.reconstruct(tasks, _full(spark, d)).select("entity_id", "status", _listed("partial").alias("partial_items"), "n")


def reconstruct_status(spark: SparkSession, d: str) -> DataFrame:
    return resolve.status_histogram(reconstructed(spark, d).select("status"))


def set_size_stats(spark: SparkSession, d: str) -> DataFrame:
    s = resolve.stats(_full(spark, d), F.size("full"))
    return s.select(F.col("minimum").cast("bigint").alias("minimum"), F.col("maximum").cast("bigint").alias("maximum"), F.round("mean", 6).alias("mean"))


def task_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = completion_tasks(spark, d)
    why = validate.task_problem(F.col("target_food"), F.col("partial_molecules"), F.col("n"))
    return rows.select(F.coalesce(why, F.lit("ok")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return split.hash_split(t(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("split_pos").cast("bigint").alias("split_pos"), "split")


def split_seeded(spark: SparkSession, d: str) -> DataFrame:
    return split.seeded_split(t(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split_pos", "split")


def split_disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    tasks = food_tasks(spark, d).select("id", "split")
    return validate.split_check({s: tasks.where(F.col("split") == s) for s in split.NAMES}, tasks.where(F.col("split").isin(*split.NAMES)))


# -- entropy and evidence


def presence_entropy(spark: SparkSession, d: str) -> DataFrame:
    return entropy.presence_entropy(food_tasks(spark, d).where("split = 'train'")).select("item", "df", F.round("entropy", 9).alias("entropy"))


def lowest_entropy_top10(spark: SparkSession, d: str) -> DataFrame:
    tasks = food_tasks(spark, d)
    return entropy.lowest_entropy(tasks.where("split = 'test'"), entropy.presence_entropy(tasks.where("split = 'train'")), 10)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").where("doc_type = 'evidence' and food_key is not null")
    return tables.evidence_by_food(rows.select(F.col("food_key").alias("key"), F.col("doc_id").alias("pos"), F.col("text").alias("snippet")))


def food_evidence(spark: SparkSession, d: str) -> DataFrame:
    keyed = completion_tasks(spark, d).select("id", "target_food")
    return evidence.food_evidence(keyed, _evidence(spark, d)).select("id", "evidence_key", "evidence_found", "raw_count", "used_count", F.md5("block").alias("block_md5"))


def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the part names of each order, three snippets (line comments) each."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    ev = t(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_brand", "p_type").alias("snippet"))
    chosen = t(spark, d, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("item")).groupBy("id", "place").agg(F.min("item").alias("item"))
    out = evidence.evidence_blocks(chosen, tables.evidence_by_molecule(ev), 3)
    return out.select("id", F.col("raw_count").cast("bigint").alias("raw_count"), F.col("used_count").cast("bigint").alias("used_count"), F.md5("block").alias("block_md5"))


# -- JSON lines and replies


def _lines(spark: SparkSession, d: str) -> DataFrame:
    v = G.strict_json("raw")
    return t(spark, d, "prediction_lines").select(F.col("line_key").alias("ord"), "raw", F.when(G.kind_of(v) == "OBJECT", v).alias("row"))


def jsonl_totals(spark: SparkSession, d: str) -> DataFrame:
    return profile.line_totals(t(spark, d, "prediction_lines"))


def jsonl_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.key_frequency(_lines(spark, d))


def food_prediction_scan(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.last_success(jsonl.food_predictions(_lines(spark, d)), "predicted_food")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies made of the task rows: fenced JSON, JSON with prose around, numbered lines, and broken JSON."""
    items = F.col("missing_molecules")
    obj = F.to_json(F.struct(F.coalesce(items, F.array().cast("array<string>")).alias("predicted_molecules")))
    kind = F.pmod(F.conv(F.substr(F.md5("id"), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(4))
    numbered = F.array_join(F.transform(items, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(m, F.lit("None")))), "\n", "")
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("I think "), obj, F.lit(" fits.")))
        .when(kind == 2, numbered)
        .otherwise(F.concat(F.lit("{"), obj))
    )
    return completion_tasks(spark, d).select("id", "n", "partial_molecules", "missing_molecules", kind.alias("kind"), reply.alias("reply"))


def reply_molecules(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("id", F.col("kind").cast("bigint").alias("kind"), F.coalesce(F.size(G.reply_molecules("reply")), F.lit(-1)).cast("bigint").alias("n_parsed"), _listed(G.reply_molecules("reply")).alias("parsed"))


def clean_prediction_list(spark: SparkSession, d: str) -> DataFrame:
    """Known molecules mixed into the answers are taken out again; at most n stay."""
    rows = completion_tasks(spark, d)
    mixed = F.concat(F.coalesce("partial_molecules", F.array().cast("array<string>")), F.coalesce("missing_molecules", F.array().cast("array<string>")))
    kept = G.clean_predictions(mixed, F.col("partial_molecules"), F.col("n"))
    return rows.select("id", _listed(kept).alias("kept"), F.size(kept).cast("bigint").alias("n_kept"))


# -- evaluation


def _lookup(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cats = tables.food_categories(t(spark, d, "food_entities"))
    cache = tables.category_cache(t(spark, d, "food_category_cache"), t(spark, d, "food_categories"))
    return cats, cache


def food_eval_details(spark: SparkSession, d: str) -> DataFrame:
    gold = food_tasks(spark, d).where("split = 'test'").select("id", "actual_food")
    rows = t(spark, d, "mfp_eval_details").where("run = 'zero-shot'")
    food = F.nullif(N.clean_prediction("predicted_food"), F.lit(""))
    scan = rows.select("id", food.alias("predicted_food"), F.when(food.isNull(), "failed").otherwise("ok").alias("status"), F.col("detail_id").alias("ord"))
    return evaluate.food_details(gold, jsonl.last_success(scan, "predicted_food"), jsonl.failed_ids(scan), *_lookup(spark, d))


def food_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.food_summary(food_eval_details(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


def extra_predictions(spark: SparkSession, d: str) -> DataFrame:
    gold = food_tasks(spark, d).where("split = 'test'").select("id")
    return evaluate.extra_predictions(t(spark, d, "mfp_eval_details").select("id").where("id is not null").distinct(), gold)


def _molecule_eval(spark: SparkSession, d: str) -> DataFrame:
    """The known molecules stand in as predictions of the missing ones."""
    tasks = completion_tasks(spark, d)
    groups = tables.molecule_groups(t(spark, d, "molecules"))
    predictions = tasks.where("partial_molecules is not null").select("id", F.filter("partial_molecules", lambda m: m.isNotNull()).alias("predicted_molecules"))
    gold = tasks.select("id", "target_food", "n", F.filter("missing_molecules", lambda m: m.isNotNull()).alias("missing_molecules"))
    return evaluate.molecule_details(gold, predictions, spark.createDataFrame([], "id string"), groups, groups)


def molecule_eval_details(spark: SparkSession, d: str) -> DataFrame:
    r = _molecule_eval(spark, d)
    num = lambda c: F.round(c, 6).alias(c)
    return r.select("id", "predicted_molecule_count", "predicted_count_equals_n", "gold_group_lookup_failures", _listed("overlap_functional_groups").alias("overlap"), *[num(c) for c in ("precision", "recall", "f1", "iou")], "failure_reason")


def molecule_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.molecule_summary(_molecule_eval(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith("average") else c for c in s.columns])


def judge_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    keys = evaluate.distinct_surface(t(spark, d, "mfp_eval_details"), "predicted_food", "detail_id")
    return evaluate.cache_misses(keys, _lookup(spark, d)[1], "food")


def judge_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    keys = evaluate.distinct_surface(t(spark, d, "mfp_eval_details"), "predicted_food", "detail_id")
    return evaluate.cache_hits(keys, _lookup(spark, d)[1], "food")


# -- sinks, resume, profiles, prompts, model


def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "mfp_tasks").where("id is not null").select("id", "actual_food", F.col("ingest_seq").alias("ord"), F.col("ingest_seq").alias("seq"))
    half = F.col("seq") % 2 == 0
    return sinks.upserted(rows.where(~half), rows.where(half)).select("id", "actual_food", "ord", "seq")


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "mfp_eval_details").where("run = 'zero-shot' and not parse_failed").select("id")
    return pipeline.pending(food_tasks(spark, d).where("split = 'test'").select("id"), done)


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "food_entities", "mfp_tasks", "molecules", "retrieved")
    return profile.table_profile({n: t(spark, d, n) for n in names})


def split_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(food_tasks(spark, d).select("split"), "split")


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    tasks = food_tasks(spark, d)
    train = tasks.where("split = 'train'").select(F.col("id").alias("demo_id"), "actual_food", "molecules")
    demos = evidence.resolved_demos(t(spark, d, "retrieval_metadata").select("id", "retrieved"), train, 3)
    rows = pipeline.with_demos(tasks.where("split = 'test'").select("id", "molecules"), demos)
    text = F.element_at(prompts.food_icl_prompt(F.col("demos"), F.col("molecules")), 2)["content"]
    return rows.select("id", F.md5(text).alias("prompt_md5"), F.length(text).cast("bigint").alias("prompt_length"))


def model_stub_generate_select(spark: SparkSession, d: str) -> DataFrame:
    """The whole generate-three-select-one run over the test tasks with a deterministic model."""

    def answer(text: str) -> str:
        import json

        if "selected_hypothesis_index" in text:
            return json.dumps({"selected_hypothesis_index": len(text) % 3 + 1, "review_reason": "length"})
        foods = [x[len("Food: ") :] for x in text.splitlines() if x.startswith("Food: ")]
        return json.dumps({"hypotheses": [{"predicted_food": f, "rationale": "an example"} for f in (foods + ["unknown"] * 3)[:3]]})

    tasks = food_tasks(spark, d)
    train = tasks.where("split = 'train'")
    test = tasks.where("split = 'test'").select("id", "molecules")
    demos = evidence.resolved_demos(t(spark, d, "retrieval_metadata").select("id", "retrieved"), train.select(F.col("id").alias("demo_id"), "actual_food", "molecules"), 3)
    chosen = entropy.lowest_entropy(test, entropy.presence_entropy(train), 10)
    items = chosen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]).alias("items"))
    nothing = spark.createDataFrame([], "id string, block string")
    out = pipeline.food_agent(test, demos, items, nothing, model.stub(answer), policy="record")
    return out.select("id", F.col("selected_hypothesis_index").cast("bigint").alias("selected_hypothesis_index"), "predicted_food", "error")


def judge_stub(spark: SparkSession, d: str) -> DataFrame:
    """New entries of the judge's cache for all predicted foods it lacks, from a deterministic model that fails on every fifth length."""
    names = sorted(r[0] for r in t(spark, d, "food_categories").select("category").where("category is not null").distinct().collect())

    def answer(text: str) -> str:
        import json

        food = text.split("\n")[0].removeprefix("Food: ")
        return "no" if len(food) % 5 == 0 else json.dumps({"category": names[len(food) % len(names)].upper()})

    keys = evaluate.distinct_surface(t(spark, d, "mfp_eval_details"), "predicted_food", "detail_id").withColumn("surface", F.regexp_replace("surface", r"[\n\r]", " "))
    new, _ = model.judge(keys, _lookup(spark, d)[1], "food", model.stub(answer), lambda c: prompts.category_prompt(c, names), lambda c: G.reply_category(c, names), "category")
    return new.select("food", "category")


def zero_shot_stub(spark: SparkSession, d: str) -> DataFrame:
    """The zero-shot run over the test tasks with a model that names the first molecule, and gives no JSON where their number is divisible by four."""

    def answer(text: str) -> str:
        import json

        items = [m for m in json.loads(text.split("\n")[0].removeprefix("Molecules: ")) if m]
        return "sorry" if len(items) % 4 == 0 else json.dumps({"predicted_food": f" {items[0]} "})

    return pipeline.zero_shot(food_tasks(spark, d).where("split = 'test'").select("id", "molecules"), "food", model.stub(answer)).select("id", "predicted_food", "error")


def icl_stub(spark: SparkSession, d: str) -> DataFrame:
    """The run with demonstrations over the test tasks, with a model that gives the food of the last example."""

    def answer(text: str) -> str:
        import json

        foods = [x[len("Food: ") :] for x in text.split("\n") if x.startswith("Food: ")]
        return json.dumps({"predicted_food": foods[-1] if foods else ""})

    tasks = food_tasks(spark, d)
    train = tasks.where("split = 'train'").select(F.col("id").alias("demo_id"), F.regexp_replace("actual_food", r"[\n\r]", " ").alias("actual_food"), "molecules")
    demos = evidence.resolved_demos(t(spark, d, "retrieval_metadata").select("id", "retrieved"), train.where("actual_food is not null"), 3)
    return pipeline.icl(tasks.where("split = 'test'").select("id", "molecules"), demos, "food", model.stub(answer), policy="record").select("id", "predicted_food", "error")


def _kind(column: str) -> F.Column:
    return F.pmod(F.conv(F.substr(F.md5(column), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(4))


def molecule_prediction_scan(spark: SparkSession, d: str) -> DataFrame:
    """Prediction lines made of the completion tasks, as arrays, as texts in brackets, with an error, and as a number; the last success of each id."""
    items = F.coalesce(F.filter("missing_molecules", lambda m: m.isNotNull()), F.array().cast("array<string>"))
    kind = _kind("id")
    listed = F.to_json(F.struct("id", items.alias("predicted_molecules")))
    text = F.to_json(F.struct("id", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("predicted_molecules")))
    failed = F.to_json(F.struct("id", items.alias("predicted_molecules"), F.lit("quota").alias("error")))
    raw = F.when(kind == 0, listed).when(kind == 1, text).when(kind == 2, failed).otherwise(F.to_json(F.struct("id", F.lit(5).alias("predicted_molecules"))))
    v = G.strict_json("raw")
    lines = completion_tasks(spark, d).select(F.col("id").alias("ord"), raw.alias("raw")).select("ord", "raw", F.when(G.kind_of(v) == "OBJECT", v).alias("row"))
    found = jsonl.last_success(jsonl.molecule_predictions(lines), "predicted_molecules")
    return found.select("id", F.size("predicted_molecules").cast("bigint").alias("n_items"), _listed("predicted_molecules").alias("items"))


def final_molecule_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the final cleaning of an answer takes out: known molecules mixed in, repeats, and what goes beyond n."""
    rows = completion_tasks(spark, d)
    mixed = F.concat(F.coalesce("partial_molecules", F.array().cast("array<string>")), F.coalesce("missing_molecules", F.array().cast("array<string>")))
    audit = rows.select("id", G.final_molecules(mixed, F.col("partial_molecules"), F.col("n")).alias("f"))
    return audit.select("id", *[F.col(f"f.{c}").cast("bigint").alias(c) for c in ("count_before", "removed_partial", "count_before_truncation", "count_after")], "f.truncated")


def completed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids with a successful prediction."""
    rows = t(spark, d, "mfp_eval_details")
    return validate.completed_ids(rows, validate.food_succeeded(F.col("id"), F.col("predicted_food"), F.when(F.col("parse_failed"), "parse_failed")))


def train_test_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Task numbers recorded in train by one table and held out by the other."""
    number = F.substring_index("id", "-", -1).alias("number")
    train = food_tasks(spark, d).where("split = 'train'").select(number)
    held = completion_tasks(spark, d).where("split <> 'train'").select(number)
    return train.join(held, "number", "left_semi")


def formatted_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Molecules as one text, all and the first three."""
    return completion_tasks(spark, d).select("id", G.joined("missing_molecules").alias("all_items"), G.joined("missing_molecules", 3).alias("first_items"))


def plain_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts without demonstrations: of the food tasks and of the completion tasks."""
    user = lambda c: F.element_at(c, 2)["content"]
    food = food_tasks(spark, d).where("split = 'test'").select(F.concat(F.lit("food:"), "id").alias("id"), user(prompts.food_prompt(F.col("molecules"))).alias("text"))
    rest = completion_tasks(spark, d).where("split = 'test' and n is not null").select(F.concat(F.lit("completion:"), "id").alias("id"), user(prompts.molecules_prompt(F.col("target_food"), F.col("partial_molecules"), F.col("n"))).alias("text"))
    return food.unionByName(rest).select("id", F.md5("text").alias("prompt_md5"))


QUERIES = (
    tokenize_counts, normalize_forms, synonym_split, functional_group_sets, doc_freq_idf, bm25_top3, bm25_zero_fill, bm25_tasks_top3,
    bm25_completion_top3, retrieval_packed, demo_resolution, retrieval_gaps, name_resolution, name_resolution_status, full_set, reconstructed,
    reconstruct_status, set_size_stats, task_problems, split_hash, split_seeded, split_disjoint_check, presence_entropy, lowest_entropy_top10,
    food_evidence, evidence_blocks, jsonl_totals, jsonl_key_profile, food_prediction_scan, reply_molecules, clean_prediction_list,
    food_eval_details, food_eval_summary, extra_predictions, molecule_eval_details, molecule_eval_summary, judge_cache_misses, judge_cache_hits,
    latest_upsert, resume_pending, table_profile, split_histogram, prompt_text, model_stub_generate_select,
    judge_stub, zero_shot_stub, icl_stub, molecule_prediction_scan, final_molecule_audit, completed_ids, train_test_overlap, formatted_molecules, plain_prompts,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
