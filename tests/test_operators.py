import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palatine.operators import entropy, evaluate, evidence, model, pipeline, resolve, retrieval, split, validate


def test_resolution_levels(spark):
    foods = spark.createDataFrame(
        [(1, "Apple", "apple_x", None, "pome; malus", "Fruit"), (2, "Pear", "apple", None, None, "Fruit"), (3, "Fig", "twin", None, None, None), (4, "Date", "twin", None, None, None)],
        "entity_id bigint, entity_alias_readable string, entity_alias string, natural_source_name string, entity_alias_synonyms string, category string",
    )
    rows = spark.createDataFrame([("a", "APPLE"), ("b", "twin"), ("c", "Malus"), ("d", "fruit"), ("e", "none"), ("f", None)], "id string, food string")
    got = {r.id: (r.match_status, r.entity_id) for r in resolve.resolve_names(rows, resolve.name_index(foods), "food").collect()}
    assert got == {"a": ("matched_unique", 1), "b": ("ambiguous", None), "c": ("matched_unique", 1), "d": ("ambiguous", None), "e": ("unmatched", None), "f": ("unmatched", None)}


def test_reconstruct(spark):
    full = spark.createDataFrame([(1, ["a", "B-c", "d"]), (2, ["a"])], "entity_id bigint, full array<string>")
    tasks = spark.createDataFrame(
        [("ok", 1, "x", ["b c", "B-C"], "matched_unique"), ("sub", 1, "x", ["zz"], "matched_unique"), ("all", 2, "x", ["A"], "matched_unique"), ("none", 3, "x", ["a"], "matched_unique"), ("amb", None, "x", ["a"], "ambiguous"), ("food", 1, " ", ["a"], "matched_unique"), ("miss", 1, "x", None, "matched_unique")],
        "id string, entity_id bigint, food string, missing array<string>, match_status string",
    )
    got = {r.id: (r.status, r.partial, r.n) for r in resolve.reconstruct(tasks, full).collect()}
    assert got["ok"] == ("ok", ["a", "d"], 2)
    assert {k: v[0] for k, v in got.items()} == {"ok": "ok", "sub": "missing_not_subset_of_full", "all": "partial_empty", "none": "empty_full_molecules", "amb": "ambiguous", "food": "invalid_food", "miss": "invalid_missing_molecules"}


WORDS = "acid ether beta alpha a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def plain_bm25(docs, query, k1=1.5, b=0.75):
    toks = {d: re.findall("[0-9a-z]+", (t or "").lower()) for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for d, t in toks.items():
        tf = Counter(t)
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / (avg or 1))) for w in re.findall("[0-9a-z]+", query.lower()) if tf[w])
        out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_bm25(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "QUERY_TOKENS", limit)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "a b"), (62, "a b")]
    queries = [(1, "a a b"), (2, "zzz"), (3, "h c"), (4, "")]
    got = retrieval.bm25_top_k(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"), 5)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, text in queries:
        want = plain_bm25(docs, text)[:5]
        assert [d for d, _ in rows[q]] == [d for d, _ in want]
        assert [s for _, s in rows[q]] == pytest.approx([s for _, s in want])


def test_bm25_in_blocks(spark, monkeypatch):
    """More query tokens than are sent at once are scored block by block, never joined; small document blocks agree, ties go by id."""
    monkeypatch.setattr(retrieval, "QUERY_TOKENS", 40)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 50)
    monkeypatch.setattr(retrieval, "_joined_scores", None, raising=False)
    monkeypatch.setattr(retrieval, "bm25_scores", None)
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    docs = [(f"d{i:03d}", some(12)) for i in range(170)]
    docs += [(f"e{i}", docs[i][1]) for i in range(170)] + [("n", None)]
    queries = [(f"q{i}", some(9)) for i in range(60)] + [("none", "zzz"), ("empty", "")]
    got = retrieval.bm25_top_k(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id string, text string"), 4)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, text in queries:
        want = plain_bm25(docs, text)[:4]
        assert [d for d, _ in rows[q]] == [d for d, _ in want]
        assert [s for _, s in rows[q]] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("share", [0.0, 0.03, 2.0])
def test_bm25_dense_and_postings_agree(spark, monkeypatch, share):
    """All tokens by matrix products, some, none: the first scores only choose, the exact ones rank."""
    monkeypatch.setattr(retrieval, "DENSE_SHARE", share)
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(WORDS[:4] + WORDS) for _ in range(n))
    docs = [(i, some(rng.randint(1, 30))) for i in range(200)]
    docs += [(300 + i, " ".join(rng.sample(docs[i][1].split(), len(docs[i][1].split())))) for i in range(50)]
    queries = [(i, some(20)) for i in range(70)]
    got = retrieval.bm25_top_k(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"), 3)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.doc_id)
    assert rows == {q: [d for d, _ in plain_bm25(docs, text)[:3]] for q, text in queries}


@pytest.mark.parametrize("tokens", [1, 3, 12])
def test_bm25_queries_are_scored_together(monkeypatch, tokens):
    """The steps of scoring are taken for many queries at once, over the blocks of documents, with floors and without; results are those of the plain way."""
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 150)
    calls, taken = [], retrieval._taken
    monkeypatch.setattr(retrieval, "_taken", lambda *a: calls.append(1) or taken(*a))
    rng = random.Random(5)
    docs = [(i, [rng.choice(WORDS) for _ in range(rng.randint(0, 20))]) for i in range(400)]
    docs += [(400 + i, docs[i][1][::-1]) for i in range(100)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(tokens)) for _ in range(200)]
    df = Counter(w for _, x in docs for w in set(x))
    rows = [(q, WORDS.index(w), c * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))) for q, x in enumerate(texts) for w, c in Counter(x.split()).items()]
    queries = retrieval._Queries(*map(np.array, zip(*rows)), len(texts), pa.array(WORDS))
    batch = pa.record_batch({"doc_id": [i for i, _ in docs], "tokens": pa.array([x for _, x in docs], pa.list_(pa.string()))})
    run = retrieval._block_scorer(queries, sum(len(x) for _, x in docs) / len(docs), 3, 1.5, 0.75)
    got = pa.Table.from_batches(run(batch.slice(at, 150) for at in range(0, len(docs), 150))).to_pylist()
    for q, text in enumerate(texts):
        want = [(d, s) for d, s in plain_bm25([(i, " ".join(x)) for i, x in docs], text)[:3] if s > 0]
        own = sorted((-round(r["score"], 6), r["doc_id"]) for r in got if r["q"] == q)
        assert [d for _, d in own] == [d for d, _ in want]
        assert [-s for s, _ in own] == pytest.approx([s for _, s in want])
    assert len(calls) < len(texts) // 4


def test_bm25_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert retrieval.bm25_top_k(empty, spark.createDataFrame([(1, "a")], "query_id bigint, text string")).count() == 0


def test_entropy(spark):
    rows = spark.createDataFrame([("1", ["A", "a ", "b"]), ("2", ["a"]), ("3", None), ("4", ["c"])], "id string, molecules array<string>")
    h = {r["item"]: r.entropy for r in entropy.presence_entropy(rows).collect()}
    assert h["a"] == pytest.approx(math.log(2)) and h["b"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))
    test = spark.createDataFrame([("x", ["a", "B", "new", "A"])], "id string, molecules array<string>")
    got = [r["item"] for r in entropy.lowest_entropy(test, entropy.presence_entropy(rows), 3).orderBy("place").collect()]
    assert got == ["new", "B", "a"]


def test_split_sizes_and_orders(spark):
    assert split.split_sizes(709) == (567, 71, 71) and split.split_sizes(710) == (568, 71, 71)
    assert split.split_sizes(0) == (0, 0, 0) and split.split_sizes(1) == (1, 0, 0) and sum(split.split_sizes(9)) == 9
    with pytest.raises(ValueError):
        split.split_sizes(10, (0.5, 0.1, 0.1))
    rows = spark.range(0, 57).withColumnRenamed("id", "o")
    got = split.seeded_split(rows, "o").orderBy("split_pos").collect()
    want = list(range(57))
    random.Random(42).shuffle(want)
    assert [r.o for r in got] == want
    h = split.hash_split(rows, "o")
    assert sorted(r.split_pos for r in h.collect()) == list(range(57))
    assert Counter(r.split for r in h.collect()) == dict(zip(split.NAMES, split.split_sizes(57)))


def test_set_metrics(spark):
    cases = [([], []), (["a"], []), ([], ["a"]), (["a"], ["b"]), (["a"], ["a"]), (["a", "b"], ["a"])]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(cases)], "i int, p array<string>, g array<string>")
    got = [r.m for r in df.select("i", evaluate.set_metrics(F.col("p"), F.col("g")).alias("m")).orderBy("i").collect()]
    assert tuple(got[0]) == (1, 1, 1, 1) and all(tuple(got[i]) == (0, 0, 0, 0) for i in (1, 2, 3))
    assert got[4].precision < 1 and got[4].recall == 1 and got[4].iou == 1
    assert got[5].precision == pytest.approx(0.5) and got[5].iou == 0.5


def test_food_evaluation(spark):
    gold = spark.createDataFrame([("1", "Apple"), ("2", "Apple"), ("3", "Apple"), ("4", "Nope"), ("5", "Apple"), (None, "Apple")], "id string, actual_food string")
    pred = spark.createDataFrame([("1", "Pear"), ("2", "odd"), ("4", "Pear"), ("9", "Pear")], "id string, predicted_food string")
    failed = spark.createDataFrame([("3",), ("1",)], "id string")
    cats = spark.createDataFrame([("Apple", "Root-crop")], "food string, category string")
    cache = spark.createDataFrame([("pear", "root crop")], "food string, category string")
    d = {r.id: r for r in evaluate.food_details(gold, pred, failed, cats, cache).collect()}
    assert d["1"].correct and d["1"].failure_reason is None
    assert [d[k].failure_reason for k in ("2", "3", "4", "5")] == ["llm_mapping_failed", "parse_failed", "gold_category_lookup_failed", "missing_prediction"]
    s = evaluate.food_summary(evaluate.food_details(gold, pred, failed, cats, cache)).first()
    assert s.total_gold == 6 and s.correct == 1 and s.accuracy == pytest.approx(1 / 6)
    assert [r.id for r in evaluate.extra_predictions(pred, gold).collect()] == ["9"]


def test_evidence_and_demos(spark):
    ev = spark.createDataFrame([("a", ["s1", "s2"])], "key string, snippets array<string>")
    sel = spark.createDataFrame([("x", 1, "A "), ("x", 2, "q")], "id string, place int, item string")
    r = evidence.evidence_blocks(sel, ev, 1).first()
    assert r.block == "A :\n- s1\n\nq:\n- no_evidence" and (r.raw_count, r.used_count) == (2, 1)
    meta = spark.createDataFrame([("x", [("t1",), ("gone",), ("t2",), ("t3",)])], "id string, retrieved array<struct<id:string>>")
    train = spark.createDataFrame([("t1", "A"), ("t2", "B"), ("t3", "C")], "demo_id string, actual_food string")
    got = [(d["rank"], d.actual_food) for d in evidence.resolved_demos(meta, train, 3).orderBy("rank").collect()]
    assert got == [(1, "A"), (3, "B")]


def test_validation(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id int") for x in ((1, 2), (2, 3)))
    row = validate.split_check({"a": a, "b": b}, a.unionByName(b)).first()
    assert row.shared == 1 and not row.covered
    with pytest.raises(ValueError):
        validate.require_disjoint(a, b)
    with pytest.raises(ValueError):
        validate.all_or_nothing(spark.createDataFrame([("ok",), ("bad",)], "status string"))


def test_model_runs(spark):
    def answer(text):
        return '{"predicted_food": "Fig"}' if "m1" in text else "nonsense"

    rows = spark.createDataFrame([("1", ["m1"]), ("2", ["m2"]), ("3", ["m1"])], "id string, molecules array<string>")
    done = spark.createDataFrame([("3",)], "id string")
    got = pipeline.zero_shot(rows, "food", model.stub(answer), done)
    assert {r.id: (r.predicted_food, r.error) for r in got.collect()} == {"1": ("Fig", None), "2": (None, "parse_failed")}
    again = pipeline.retry_errors(got, rows.where("id <> '2'"), lambda r: pipeline.zero_shot(r, "food", model.stub(answer)))
    assert {r.id: r.error for r in again.collect()} == {"1": None, "2": "missing_input_row"}

    def boom(messages, options=None):
        return model.Reply(None, error="down")

    with pytest.raises(Exception, match="down"):
        pipeline.zero_shot(rows, "food", boom, policy="abort").collect()


def test_molecule_agent(spark):
    def answer(text):
        if "selected_hypothesis_index" in text:
            return '{"selected_hypothesis_index": 2}'
        return '{"hypotheses": [' + ", ".join(f'{{"predicted_molecules": ["k", "m{i}", "x", "y"]}}' for i in range(3)) + "]}"

    rows = spark.createDataFrame([("1", "Fig", ["K"], 2)], "id string, target_food string, partial_molecules array<string>, n bigint")
    demos = spark.createDataFrame([], "id string, rank int, demo_id string, target_food string, partial_molecules array<string>, missing_molecules array<string>")
    none = spark.createDataFrame([], "id string, block string")
    r = pipeline.molecule_agent(rows, demos, none, model.stub(answer)).first()
    assert r.predicted_molecules == ["m1", "x"] and r.error is None

    def cut(messages, options=None):
        text = messages[-1]["content"]
        if "exactly three" in text:
            return model.Reply("", "length")
        return model.Reply(answer(text) if "selected" in text else '{"predicted_molecules": ["z"]}')

    r = pipeline.molecule_agent(rows, demos, none, cut).first()
    assert r.predicted_molecules == ["z"]



def test_molecule_agent_asks_singles(spark):
    bad = {"bad json": "nonsense", "two": '{"hypotheses": [{"predicted_molecules": ["a"]}, {"predicted_molecules": ["b"]}]}', "nothing new": '{"hypotheses": [' + ", ".join(['{"predicted_molecules": ["K"]}'] * 3) + "]}", "down": None}

    def client(messages, options=None):
        text = messages[-1]["content"]
        if "exactly three" in text:
            reply = next(v for k, v in bad.items() if k in text)
            return model.Reply(reply, error=None if reply else "HTTP 500")
        return model.Reply('{"selected_hypothesis_index": 1}' if "selected" in text else '{"predicted_molecules": ["z"]}')

    rows = spark.createDataFrame([(k, k, ["K"], 2) for k in bad], "id string, target_food string, partial_molecules array<string>, n bigint")
    demos = spark.createDataFrame([], "id string, rank int, demo_id string, target_food string, partial_molecules array<string>, missing_molecules array<string>")
    none = spark.createDataFrame([], "id string, block string")
    got = pipeline.molecule_agent(rows, demos, none, client, policy="abort").collect()
    assert {r.id: (r.predicted_molecules, r.error) for r in got} == {k: (["z"], None) for k in bad}


def test_judge_memo(spark):
    keys = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "key string, surface string")
    cache = spark.createDataFrame([("a", "x")], "food string, category string")
    from palatine.functions.parse import reply_category
    from palatine.operators.prompts import category_prompt

    new, bad = model.judge(keys, cache, "food", model.stub(lambda t: '{"category": "x"}' if "Food: B" in t else "?"), lambda c: category_prompt(c, ["x"]), lambda c: reply_category(c, ["x"]), "category")
    assert [tuple(r) for r in new.collect()] == [("b", "x")] and [r.key for r in bad.collect()] == ["c"]
