"""Row validity, completed ids and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.functions.normalize import strip
from palatine.sources.sinks import path_exists


def task_problem(food: Column, molecules: Column, n: Column | None = None, names: tuple[str, str] = ("invalid_target_food", "invalid_partial_molecules")) -> Column:
    """Why a task row cannot be used, null if it can: food, molecule list, then n, in this order."""
    why = F.when(food.isNull() | (strip(food) == ""), names[0]).when(molecules.isNull(), names[1])
    return why if n is None else why.when(n.isNull() | (n <= 0), "invalid_n")


def food_succeeded(id_: Column, food: Column, error: Column) -> Column:
    """Whether a food prediction row is a success: id, no error, a non-blank text."""
    return F.coalesce(id_.isNotNull() & (F.coalesce(error, F.lit("")) == "") & (strip(food) != ""), F.lit(False))


def molecules_succeeded(id_: Column, molecules: Column, error: Column) -> Column:
    return F.coalesce(id_.isNotNull() & (F.coalesce(error, F.lit("")) == "") & (F.size(molecules) > 0), F.lit(False))


def completed_ids(rows: DataFrame, success: Column) -> DataFrame:
    """Ids that a resumed run skips."""
    return rows.where(success).select(F.col("id").cast("string").alias("id")).distinct()


def valid_retrieval_ids(rows: DataFrame, version: str, column: str = "protocol_version") -> DataFrame:
    return rows.where((F.col(column) == version) & F.col("retrieved").isNotNull()).select(F.col("id").cast("string").alias("id")).distinct()


def hypotheses_complete(hypotheses: Column, index: Column, has_answer) -> Column:
    """Exactly three hypotheses that each satisfy ``has_answer``, and a selected index from 1 to 3."""
    return F.coalesce((F.size(hypotheses) == 3) & F.forall(hypotheses, has_answer) & index.between(1, 3), F.lit(False))


def split_check(parts: dict[str, DataFrame], total: DataFrame, key: str = "id") -> DataFrame:
    """(part_a, part_b, shared, covered): ids shared by two parts, and whether all parts together have as many ids as rows in all.

    One pass: ids are grouped once, no part is joined with another.
    """
    names = sorted(parts)
    tagged = None
    for n in names:
        one = parts[n].select(F.col(key).cast("string").alias("k"), F.lit(n).alias("part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    ids = tagged.groupBy("k").agg(F.collect_set("part").alias("in_parts"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = ids.agg(F.count(F.lit(1)).alias("ids"), *[F.count_if(F.array_contains("in_parts", a) & F.array_contains("in_parts", b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = total.agg(F.count(F.lit(1)).alias("rows"))
    shown = F.explode(F.array(*[F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.col(f"`{a}|{b}`").alias("shared")) for a, b in pairs]))
    return counts.join(F.broadcast(rows), how="cross").select(shown.alias("p"), (F.col("ids") == F.col("rows")).alias("covered")).select("p.*", "covered")


def require_disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    """Fails if an id is in both."""
    hit = a.select(F.col(key).cast("string").alias("k")).join(b.select(F.col(key).cast("string").alias("k")), "k", "left_semi").limit(1).collect()
    if hit:
        raise ValueError(f"id {hit[0][0]!r} is in both parts")


def incomplete_retrieval(ids: DataFrame, retrieval: DataFrame, k: int = 3) -> DataFrame:
    """(id, found): ids with fewer than k demos, or none recorded."""
    have = retrieval.select(F.col("id").cast("string").alias("id"), F.coalesce(F.size("retrieved"), F.lit(0)).alias("found"))
    return ids.select(F.col("id").cast("string").alias("id")).join(have, "id", "left").select("id", F.coalesce(F.greatest("found", F.lit(0)), F.lit(0)).alias("found")).where(F.col("found") < k)


def file_report(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, status): PASS or FAIL for every required path."""
    return spark.createDataFrame([(p, "PASS" if path_exists(spark, p) else "FAIL") for p in paths], "path string, status string")


def all_or_nothing(rows: DataFrame, problem: str = "status", good: str = "ok") -> DataFrame:
    """``rows`` if every one is good, else an error with the counts per problem; nothing may be written then."""
    bad = rows.where(F.coalesce(F.col(problem), F.lit("null")) != good).groupBy(problem).count().collect()
    if bad:
        raise ValueError("invalid rows: " + ", ".join(f"{r[0]}={r[1]}" for r in sorted(bad, key=str)))
    return rows
