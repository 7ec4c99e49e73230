"""Command line: ``python -m palatine COMMAND …``; exit 0 for success, 1 for an error, 42 for a spent quota."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.functions import parse
from palatine.operators import entropy, evaluate, evidence, model, pipeline, profile, prompts, resolve, retrieval, split, validate
from palatine.operators.physical import checkpoint
from palatine.sources import env, jsonl, sinks, tables

FOOD = "id string, task string, actual_food string, molecules array<string>"
COMPLETION = "id string, task string, target_food string, partial_molecules array<string>, n bigint, missing_molecules array<string>"
RETRIEVAL = "id string, retrieved array<struct<rank: int, id: string, score: double, actual_food: string, target_food: string>>, protocol_version string"
#: Versions of what recorded retrieval and the judge's cache hold.
PROTOCOL, JUDGE_PROMPT = "bm25-1", "1"
RAW = "id string, task string, food string, missing_molecules array<string>"


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its path; the format is the ending's."""
    fmt = path.rstrip("/").rsplit(".", 1)[-1]
    return spark.read.format({"jsonl": "json"}.get(fmt, fmt)).load(path)


def _tasks(spark: SparkSession, path: str, task: str) -> DataFrame:
    return jsonl.read_jsonl(spark, path, FOOD if task == "food" else COMPLETION, require_id=True)


def reconstruct(spark: SparkSession, a: argparse.Namespace) -> dict:
    tasks = jsonl.read_jsonl(spark, a.tasks, RAW)
    foods, items, links = (_table(spark, p) for p in (a.foods, a.molecules, a.links))
    key, name = tables.pick_column(items, "id", "molecule_id"), tables.pick_column(items, "common_name", "name", "iupac_name")
    named = items.select(F.col(key).alias("molecule_id"), F.col(name).alias("common_name"))
    index = resolve.name_index(foods, key=tables.pick_column(foods, "entity_id", "id"))
    found = resolve.resolve_names(tasks.withColumnRenamed("missing_molecules", "missing"), index, "food")
    rows = resolve.reconstruct(found, resolve.full_sets(links, named))
    good = validate.all_or_nothing(rows)
    out = good.select("ord", "id", "task", F.col("food").alias("target_food"), F.col("partial").alias("partial_molecules"), "n", F.col("missing").alias("missing_molecules"))
    sinks.write_jsonl(out.orderBy("ord").drop("ord"), a.output)
    return {r["status"]: r["rows"] for r in resolve.status_histogram(rows).collect()}


def split_rows(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _tasks(spark, a.input, a.task)
    ratios = tuple(a.ratios)
    if a.hash:
        placed = split.hash_split(rows, "id", str(a.seed), ratios)
    else:
        placed = split.seeded_split(rows, "ord", a.seed, ratios)
    parts = {n: placed.where(F.col("split") == n) for n in split.NAMES}
    if not all(r.shared == 0 and r.covered for r in validate.split_check(parts, rows).collect()):
        raise ValueError("splits overlap or miss ids")
    for n, part in parts.items():
        sinks.write_jsonl(part.orderBy("split_pos").drop("split", "split_pos", "ord"), f"{a.output}/{n}.jsonl")
        sinks.write_ids(part.orderBy("split_pos"), f"{a.output}/{n}_ids.txt")
    return {n: p.count() for n, p in parts.items()}


def check(spark: SparkSession, a: argparse.Namespace) -> dict:
    report = {r.path: r.status for r in validate.file_report(spark, *a.paths).collect()}
    if "FAIL" in report.values():
        raise FileNotFoundError(", ".join(p for p, s in report.items() if s == "FAIL"))
    out: dict = {}
    for p in a.paths:
        raw = spark.read.text(p).withColumnRenamed("value", "raw")
        total = profile.line_totals(raw).first().asDict()
        keys = profile.key_frequency(jsonl.scan_lines(spark, p))
        out[p] = total | {"keys": {r["key"]: r["rows"] for r in keys.collect()}}
        if total["bad"]:
            raise ValueError(f"{p}: {total['bad']} bad lines")
    return out


def _corpus(rows: DataFrame, task: str, as_query: bool) -> DataFrame:
    if task == "food":
        text = retrieval.molecule_text("molecules") if as_query else retrieval.food_document("actual_food", "molecules")
    elif as_query:
        text = retrieval.completion_query("target_food", "partial_molecules")
    else:
        text = retrieval.completion_document("target_food", "partial_molecules", "missing_molecules")
    return rows.select(F.col("id").alias("query_id") if as_query else F.col("ord").alias("doc_id"), text.alias("text"))


def _retrieved(train: DataFrame, test: DataFrame, task: str, k: int) -> DataFrame:
    """(id, retrieved) with the ids of the training rows; positions decide ties."""
    validate.require_disjoint(train, test)
    best = retrieval.bm25_top_k(_corpus(train, task, False), _corpus(test, task, True), k)
    food = "actual_food" if task == "food" else "target_food"
    named = best.join(train.select(F.col("ord").alias("doc_id"), F.col("id").alias("demo"), food), "doc_id")
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("demo").alias("id"), "score", food)
    return named.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("retrieved"))


def retrieve(spark: SparkSession, a: argparse.Namespace) -> dict:
    train, test = (_tasks(spark, p, a.task) for p in (a.train, a.test))
    out = _retrieved(train, test, a.task, a.k)
    sinks.write_jsonl(out, a.output)
    return {"rows": out.count()}


def _client(a: argparse.Namespace) -> model.ChatClient:
    env.load_settings(os.getcwd())
    client = model.ChatClient(env.resolve(a.url, os.environ.get("PALATINE_MODEL_URL")), env.resolve(a.model, os.environ.get("PALATINE_MODEL")), a.key_env)
    return replace(client, options=client.options | {"max_tokens": a.max_tokens}) if getattr(a, "max_tokens", None) else client


def _demos(spark: SparkSession, a: argparse.Namespace, train: DataFrame, test: DataFrame) -> DataFrame:
    """Demonstrations of the test rows; retrieval recorded under the same protocol is used again, else recorded."""
    cols = ("actual_food", "molecules") if a.task == "food" else ("target_food", "partial_molecules", "missing_molecules")
    if a.retrieval and sinks.path_exists(spark, a.retrieval):
        found = tables.retrieval_rows(spark.read.schema(RETRIEVAL).json(a.retrieval), PROTOCOL)
        if lacking := validate.incomplete_retrieval(test, found, a.k).count():
            raise ValueError(f"{lacking} rows have fewer than {a.k} demonstrations in {a.retrieval}")
    else:
        found = _retrieved(train, test, a.task, a.k)
        if a.retrieval:
            sinks.write_jsonl(found.withColumn("protocol_version", F.lit(PROTOCOL)), a.retrieval)
    return evidence.resolved_demos(found, train.select(F.col("id").alias("demo_id"), *cols), a.k)


def _run(spark: SparkSession, a: argparse.Namespace, test: DataFrame, done: DataFrame | None) -> DataFrame:
    """The results of a method over the ``test`` rows that are not ``done``."""
    client = _client(a)
    if a.method == "zero-shot":
        return pipeline.zero_shot(test, a.task, client, done, "record", a.parallel)
    train = _tasks(spark, a.train, a.task)
    demos = _demos(spark, a, train, test)
    if a.method == "icl":
        return pipeline.icl(test, demos, a.task, client, done, "abort", a.parallel)
    known = checkpoint(spark.read.parquet(a.hypotheses)) if a.hypotheses and sinks.path_exists(spark, a.hypotheses) else None  # read now, since record() replaces the table

    def record(new: DataFrame) -> None:
        if a.hypotheses:
            sinks.upsert_table(new.withColumn("ord", F.lit(0)), a.hypotheses)

    if a.task == "food":
        chosen = entropy.lowest_entropy(test, entropy.presence_entropy(train), a.starting_points)
        blocks = evidence.evidence_blocks(chosen, tables.evidence_by_molecule(_table(spark, a.evidence)), a.snippets)
        items = chosen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda s: s["item"]).alias("items"))
        return pipeline.food_agent(test, demos, items, blocks, client, done, "abort", a.parallel, known, record)
    blocks = evidence.food_evidence(test, tables.evidence_by_food(_table(spark, a.evidence)), limit=a.snippets or 10)
    return pipeline.molecule_agent(test, demos, blocks, client, done, "record", a.reviewer_evidence == "full", a.parallel, known, record)


def predict(spark: SparkSession, a: argparse.Namespace) -> dict:
    test = _tasks(spark, a.test, a.task)
    done = None
    sinks.recover(spark, a.output)
    if a.retry_errors:
        old = spark.read.parquet(a.output)
        bad = checkpoint(old.where("error is not null").select("id"))
        lost = bad.join(test.select("id"), "id", "left_anti").withColumn("error", F.lit("missing_input_row"))
        got = _run(spark, a, test.join(bad, "id", "left_semi"), None).unionByName(lost, allowMissingColumns=True)
    else:
        if a.resume and sinks.path_exists(spark, a.output):
            done = pipeline.done_ids(spark.read.parquet(a.output), "all" if a.method == "zero-shot" else "successes")
        elif not a.resume:
            sinks.guard_output(spark, a.output)
        got = _run(spark, a, test, done)
    got = checkpoint(got)
    order = test.select("id", "ord")
    sinks.upsert_table(got.join(order, "id", "left").withColumn("ord", F.coalesce("ord", F.lit(0))), a.output)
    return {"asked": got.count(), "failed": got.where("error is not null").count()}


def _judge(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, words: list[str], cache: DataFrame | None, key: str, prompt, parsed, value: str) -> dict:
    """Ask the judge for every surface text that the cache at ``a.cache`` lacks, and write the replies to it."""
    client = _client(a)
    digest = hashlib.sha256("\n".join(sorted(words)).encode()).hexdigest()
    sinks.bind_cache(spark, a.cache, {"model": client.model, "url": client.url, "prompt_version": JUDGE_PROMPT, "vocabulary_sha256": digest}, cache is None or cache.isEmpty())
    known = spark.createDataFrame([], f"{key} string") if cache is None else cache.select(evaluate.surface_text(key).alias(key))
    new, failed = model.judge(evaluate.distinct_surface(rows, "surface", "ord"), known, key, client, lambda c: prompt(c, words), parsed, value, a.parallel)
    if "entry_key" in (cache.columns if cache is not None else ["entry_key"]) and key == "food_key":
        new = new.withColumn("entry_key", F.col(key))
    if not new.isEmpty():
        sinks.write_cache(cache, new if cache is None else new.select(*cache.columns), a.cache, key)
    return {"judge_calls": new.count() + failed.count(), "judge_failures": failed.count()}


def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    gold = jsonl.read_jsonl(spark, a.gold, FOOD if a.task == "food" else COMPLETION, "skip")
    lines = jsonl.scan_lines(spark, a.predictions)
    sinks.recover(spark, a.cache)
    cache = _table(spark, a.cache) if sinks.path_exists(spark, a.cache) else None
    calls: dict = {}
    if a.task == "food":
        scan = jsonl.food_predictions(lines)
        words = _table(spark, a.vocabulary) if a.vocabulary else spark.createDataFrame([(c,) for c in prompts.FOOD_CATEGORIES], "category string")
        if a.use_llm:
            names = [r[0] for r in words.select("category").where("category is not null").collect()]  # the judge's vocabulary, shown in every prompt
            found = jsonl.last_success(scan, "predicted_food", "ord").select(F.col("predicted_food").alias("surface"), "ord")
            calls = _judge(spark, a, found, names, cache, "food_key", prompts.category_prompt, lambda c: parse.reply_category(c, names), "category")
            cache = _table(spark, a.cache) if sinks.path_exists(spark, a.cache) else None
        cache = spark.createDataFrame([], "entry_key string, food_key string, category string") if cache is None else cache
        details = evaluate.food_details(gold, jsonl.last_success(scan, "predicted_food"), jsonl.failed_ids(scan), tables.food_categories(_table(spark, a.reference)), tables.category_cache(cache, words))
        summary = evaluate.food_summary(details)
    else:
        scan = jsonl.molecule_predictions(lines)
        if a.use_llm:
            found = jsonl.last_success(scan, "predicted_molecules", "ord").select(F.explode("predicted_molecules").alias("surface"), "ord")
            calls = _judge(spark, a, found, prompts.FUNCTIONAL_GROUPS, cache, "molecule", prompts.groups_prompt, parse.reply_groups, "groups")
            cache = _table(spark, a.cache) if sinks.path_exists(spark, a.cache) else None
        cache = spark.createDataFrame([], "molecule string, groups array<string>") if cache is None else cache
        details = evaluate.molecule_details(gold, jsonl.last_success(scan, "predicted_molecules"), jsonl.failed_ids(scan), tables.molecule_groups(_table(spark, a.reference)), tables.groups_cache(cache))
        summary = evaluate.molecule_summary(details)
    if not a.no_details:
        sinks.write_jsonl(details, f"{a.output}/evaluation_details.jsonl")
    sinks.write_document(summary, f"{a.output}/evaluation_summary.json")
    return summary.first().asDict() | calls


def api_config(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Whether the model's key is there; the key is neither used nor shown."""
    env.load_settings(os.getcwd())
    return {"key_env": a.key_env, "found": bool(os.environ.get(a.key_env))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palatine")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: str, task: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if task:
            c.add_argument("--task", choices=("food", "completion"), default="food")
        for o in options:
            c.add_argument(f"--{o}", required=True)
        return c

    def calls(c: argparse.ArgumentParser) -> None:
        for o in ("url", "model"):
            c.add_argument(f"--{o}")
        c.add_argument("--key-env", default="PALATINE_MODEL_KEY")
        c.add_argument("--parallel", type=int)

    command("reconstruct", reconstruct, "tasks", "foods", "molecules", "links", "output", task=False)
    c = command("split", split_rows, "input", "output")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--ratios", type=float, nargs=3, default=(0.8, 0.1, 0.1))
    c.add_argument("--hash", action="store_true", help="order by digest instead of the seeded shuffle")
    command("check", check, task=False).add_argument("paths", nargs="+")
    c = command("retrieve", retrieve, "train", "test", "output")
    c.add_argument("--k", type=int, default=3)
    c = command("predict", predict, "test", "output")
    c.add_argument("--method", choices=("zero-shot", "icl", "agent"), required=True)
    for o in ("train", "evidence"):
        c.add_argument(f"--{o}")
    calls(c)
    c.add_argument("--k", type=int, default=3)
    c.add_argument("--resume", action="store_true")
    c.add_argument("--retry-errors", action="store_true", help="ask again for the rows of the output that failed")
    c.add_argument("--retrieval", help="JSON lines of recorded retrieval: used if there, else written")
    c.add_argument("--hypotheses", help="table of recorded hypotheses (agent): used for the rows it has, completed by the others")
    c.add_argument("--starting-points", type=int, default=10)
    c.add_argument("--snippets", type=int, help="evidence snippets per item; all of a molecule, ten of a food if not given")
    c.add_argument("--reviewer-evidence", choices=("full", "none"), default="full")
    c.add_argument("--max-tokens", type=int)
    c = command("evaluate", score, "gold", "predictions", "reference", "cache", "output")
    c.add_argument("--vocabulary", help="table of category names (food)")
    c.add_argument("--use-llm", action="store_true", help="ask the judge for what the cache lacks")
    c.add_argument("--no-details", action="store_true")
    calls(c)
    command("api-config", api_config, task=False).add_argument("--key-env", default="PALATINE_MODEL_KEY")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"palatine-{a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(sinks.status_line(a.command.upper(), "PASS", a.run(spark, a)))
        return 0
    except Exception as e:
        text = str(e)
        print(sinks.status_line(a.command.upper(), "FAIL", {"error": text[:500]}), file=sys.stderr)
        return 42 if isinstance(e, model.QuotaExceeded) or "QuotaExceeded" in text else 1


if __name__ == "__main__":
    sys.exit(main())
