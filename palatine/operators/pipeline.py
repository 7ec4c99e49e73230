"""Prediction runs: zero-shot, retrieval-augmented, and generate-three-select-one.

Each run is resumable: ids done before are anti-joined away, new rows are
asked, parsed into one result per row, and upserted by the caller.  How a
method treats failures is a parameter (``policy``, ``skip``) instead of being
built into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palatine.functions import parse
from palatine.functions.normalize import first_truthy
from palatine.operators import prompts
from palatine.operators.model import Reply, ask


def pending(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows whose id is not in ``done``."""
    return rows if done is None else rows.join(done.select("id").distinct(), "id", "left_anti")


def done_ids(results: DataFrame, skip: str = "successes") -> DataFrame:
    """Ids a resumed run skips: all recorded ones (``all``) or those without an error (``successes``)."""
    return (results if skip == "all" else results.where("error is null")).select("id").distinct()


def food_results(asked: DataFrame) -> DataFrame:
    """(id, predicted_food, error) of replies."""
    food = parse.reply_food("reply")
    return asked.select("id", food.alias("predicted_food"), F.when(food.isNull(), F.coalesce("error", F.lit("parse_failed"))).alias("error"))


def molecule_results(asked: DataFrame) -> DataFrame:
    """(id, predicted_molecules, error) of replies, cleaned against the row's known molecules and n."""
    raw = parse.reply_molecules("reply")
    clean = parse.clean_predictions(raw, F.col("partial_molecules"), F.col("n"))
    why = F.when(raw.isNull(), F.coalesce("error", F.lit("parse_failed"))).when(F.size(clean) == 0, "empty_prediction")
    return asked.select("id", F.when(why.isNull(), clean).alias("predicted_molecules"), why.alias("error"))


def zero_shot(rows: DataFrame, task: str, client: Callable[..., Reply], done: DataFrame | None = None, policy: str = "record", parallel: int | None = None) -> DataFrame:
    todo = pending(rows, done)
    if task == "food":
        return food_results(ask(todo.withColumn("messages", prompts.food_prompt(F.col("molecules"))), client, policy=policy, parallel=parallel))
    prompt = prompts.molecules_prompt(F.col("target_food"), F.col("partial_molecules"), F.col("n"))
    return molecule_results(ask(todo.withColumn("messages", prompt), client, policy=policy, parallel=parallel))


def retry_errors(results: DataFrame, rows: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results with their failures redone in place; a failure without an input row is marked missing_input_row."""
    bad = results.where("error is not null")
    redo = rows.join(bad.select("id"), "id", "left_semi")
    lost = bad.join(rows.select("id"), "id", "left_anti").withColumn("error", F.lit("missing_input_row"))
    return results.where("error is null").unionByName(again(redo)).unionByName(lost)


def with_demos(rows: DataFrame, demos: DataFrame) -> DataFrame:
    """``rows`` with ``demos``: the array of their demonstrations (id, rank, …) by rank."""
    cols = [c for c in demos.columns if c not in ("id", "rank", "demo_id")]
    listed = demos.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda d: F.struct(*[d[c].alias(c) for c in cols])).alias("demos"))
    return rows.join(listed, "id", "left").withColumn("demos", F.coalesce("demos", F.array().cast(listed.schema["demos"].dataType)))


def icl(rows: DataFrame, demos: DataFrame, task: str, client: Callable[..., Reply], done: DataFrame | None = None, policy: str = "abort", parallel: int | None = None) -> DataFrame:
    todo = with_demos(pending(rows, done), demos)
    if task == "food":
        return food_results(ask(todo.withColumn("messages", prompts.food_icl_prompt(F.col("demos"), F.col("molecules"))), client, policy=policy, parallel=parallel))
    prompt = prompts.molecules_icl_prompt(F.col("demos"), F.col("target_food"), F.col("partial_molecules"), F.col("n"))
    return molecule_results(ask(todo.withColumn("messages", prompt), client, policy=policy, parallel=parallel))


def staged(todo: DataFrame, make: Callable[[DataFrame], DataFrame], known: DataFrame | None, record: Callable[[DataFrame], None] | None) -> DataFrame:
    """``todo`` with (hypotheses, error): those ``known`` (id, hypotheses) from an interrupted run, and what ``make`` asks for the others.

    ``record`` gets the new hypotheses (id, hypotheses) before anything is asked
    about them.
    """
    if known is not None:
        known = known.where(F.size("hypotheses") == 3).select("id", "hypotheses")
        new = make(todo.join(known.select("id"), "id", "left_anti"))
    else:
        new = make(todo)
    if record is not None:
        record(new.where("hypotheses is not null").select("id", "hypotheses"))
    return new if known is None else new.unionByName(todo.join(known, "id").withColumn("error", F.lit(None).cast("string")))


def food_agent(
    rows: DataFrame, demos: DataFrame, selected: DataFrame, evidence: DataFrame, client: Callable[..., Reply], done: DataFrame | None = None, policy: str = "abort", parallel: int | None = None,
    known: DataFrame | None = None, record: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """(id, hypotheses, selected_hypothesis_index, review_reason, predicted_food, error).

    ``selected`` (id, items), ``evidence`` (id, block).  The answer is one of the
    three hypotheses as it stands.  ``known`` and ``record`` are as of staged.
    """
    todo = with_demos(pending(rows, done), demos).join(selected, "id", "left").join(evidence.select("id", "block"), "id", "left")
    block = F.coalesce("block", F.lit(""))

    def make(some: DataFrame) -> DataFrame:
        some = some.withColumn("messages", prompts.food_scientist_prompt(F.col("molecules"), F.col("items"), block, F.col("demos")))
        return ask(some, client, policy=policy, parallel=parallel).withColumn("hypotheses", parse.hypotheses_foods("reply")).drop("messages", "reply", "finish_reason")

    made = staged(todo, make, known, record)
    failed = made.where("hypotheses is null").select("id", F.coalesce("error", F.lit("hypotheses_parse_failed")).alias("error"))
    task = F.concat(F.lit("Molecules: "), parse.joined("molecules"))
    ask2 = made.where("hypotheses is not null").drop("error").withColumn("messages", prompts.reviewer_prompt(task, prompts.food_demos(F.col("demos")), parse.numbered_foods("hypotheses"), block))
    chosen = ask(ask2, client, policy=policy, parallel=parallel).withColumn("choice", parse.reviewer_choice("reply"))
    good = chosen.select("id", "hypotheses", "choice.selected_hypothesis_index", "choice.review_reason", F.try_element_at("hypotheses", F.col("choice.selected_hypothesis_index"))["predicted_food"].alias("predicted_food"), F.when(F.col("choice").isNull(), F.coalesce("error", F.lit("review_parse_failed"))).alias("error"))
    return good.unionByName(failed, allowMissingColumns=True)


def molecule_agent(
    rows: DataFrame, demos: DataFrame, evidence: DataFrame, client: Callable[..., Reply], done: DataFrame | None = None, policy: str = "record", show_evidence: bool = True, parallel: int | None = None,
    known: DataFrame | None = None, record: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """(id, hypotheses, selected_hypothesis_index, predicted_molecules, audit, error); falls back to three single replies.

    The fallback is asked where the batch reply was cut off, holds no three
    valid hypotheses or is an error; it is a checkpointed stage of its own.
    ``known`` and ``record`` are as of staged.
    """
    todo = with_demos(pending(rows, done), demos).join(evidence.select("id", "block"), "id", "left")
    block = F.coalesce("block", F.lit(""))
    food, partial, n = F.col("target_food"), F.col("partial_molecules"), F.col("n")
    singles = F.array(*[prompts.molecules_scientist_prompt(food, partial, n, block, F.col("demos"), k) for k in range(3)])
    replies = F.from_json("reply", "array<string>")
    one = F.transform(replies, lambda r: F.struct(parse.final_molecules(parse.reply_molecules_agent(r), partial, n)["molecules"].alias("predicted_molecules"), F.lit("").alias("rationale")))
    three = F.when((F.size(one) == 3) & F.forall(one, lambda h: F.size(h["predicted_molecules"]) > 0), one)

    def make(some: DataFrame) -> DataFrame:
        some = some.withColumn("messages", prompts.molecules_scientist_prompt(food, partial, n, block, F.col("demos"))).withColumn("singles", singles)
        batch = ask(some, client, policy="record", parallel=parallel).withColumn("hypotheses", F.when(F.coalesce("finish_reason", F.lit("")) != "length", parse.hypotheses_molecules("reply", partial, n)))
        redo = batch.where("hypotheses is null").drop("reply", "finish_reason", "error", "hypotheses")
        again = ask(redo, client, policy=policy, parallel=parallel, prompts="singles").withColumn("hypotheses", three)
        return batch.where("hypotheses is not null").unionByName(again).drop("messages", "singles", "reply", "finish_reason")

    made = staged(todo, make, known, record)
    failed = made.where("hypotheses is null").select("id", F.coalesce("error", F.lit("hypotheses_parse_failed")).alias("error"))
    task = F.concat(F.lit("Food: "), first_truthy(food), F.lit("\nKnown molecules: "), parse.joined(partial))
    review: Column = prompts.reviewer_prompt(task, prompts.molecule_demos(F.col("demos")), parse.numbered_molecules("hypotheses"), block if show_evidence else None)
    ask2 = made.where("hypotheses is not null").drop("error").withColumn("messages", review)
    chosen = ask(ask2, client, policy=policy, parallel=parallel).withColumn("choice", parse.reviewer_choice("reply"))
    picked = F.try_element_at("hypotheses", F.col("choice.selected_hypothesis_index"))["predicted_molecules"]
    audit = parse.final_molecules(picked, partial, n)
    good = chosen.select("id", "hypotheses", "choice.selected_hypothesis_index", F.when(F.col("choice").isNotNull(), audit["molecules"]).alias("predicted_molecules"), F.when(F.col("choice").isNotNull(), audit).alias("audit"), F.when(F.col("choice").isNull(), F.coalesce("error", F.lit("review_parse_failed"))).alias("error"))
    return good.unionByName(failed, allowMissingColumns=True)
