import math
import random

from palatine.llm import topn


def brute(rows, limits):
    latest = {}
    for g, i, s, score in rows:
        if g is not None and i is not None and (s, 1) >= (latest.get((g, i), (-1, None))[0], 1):
            latest[g, i] = (s, score)
    out = set()
    for g, n in limits.items():
        best = sorted(((-v, i) for (h, i), (_, v) in latest.items() if h == g and v is not None and not math.isnan(v)))[: max(0, n or 0)]
        out |= {(g, k + 1, i) for k, (_, i) in enumerate(best)}
    return out


def run(spark, rows, limits):
    r = spark.createDataFrame(rows, "id string, item string, seq bigint, score double")
    return {tuple(x) for x in topn.top_n_per_group(r, spark.createDataFrame(list(limits.items()), "id string, n int")).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *(f"i{k:03d}" for k in range(200))]), s, rng.choice([None, float("nan"), *(float(x) for x in range(20))])) for s in range(4000)]
    limits = {"hot": 25, "a": 3, "b": 0, "gone": 5}
    assert run(spark, rows, limits) == brute(rows, limits)


def test_small_flush_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(topn, "heap_batches", lambda f=topn.heap_batches: f(7, 1))
    rows = [("g", f"i{k}", k, float(k % 7)) for k in range(300)]
    assert run(spark, rows, {"g": 10}) == brute(rows, {"g": 10})


def test_empty_and_null_limits(spark):
    assert run(spark, [], {"g": 3}) == set()
    assert run(spark, [("g", "i", 1, 1.0)], {"g": None}) == set()
    assert run(spark, [("g", "i", 1, 0.0), ("g", "j", 1, -0.0)], {"g": 2}) == {("g", 1, "i"), ("g", 2, "j")}


def test_many_repeated_items(spark):
    """Beyond the bound on what is broadcast all rows are reduced by a shuffle, with the same result."""
    rows = [("g", f"i{k % 40}", k, float((k * 7) % 31)) for k in range(200)]
    r = spark.createDataFrame(rows, "id string, item string, seq bigint, score double")
    limits = spark.createDataFrame([("g", 6)], "id string, n int")
    assert {tuple(x) for x in topn.top_n_per_group(r, limits, repeated=0).collect()} == brute(rows, {"g": 6})
