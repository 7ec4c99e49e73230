import pytest
from pyspark.sql import functions as F

from palatine.functions import parse as G


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn("c")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"predicted_molecules": ["a", "b"]}', ["a", "b"]),
        ('Sure:\n```json\n{"predicted_molecules": ["a"]}\n```\nbye', ["a"]),
        ('I think {"predicted_molecules": ["a"]} fits', ["a"]),
        ('["x", 1, {"k": 2}]', ["x", "1", '{"k":2}']),
        ('well ["x"] ok', ["x"]),
        ('{"predicted_molecules": "a"}', None),
        ("1. alpha,\n2) 'beta'\n- gamma;\nno item\n• delta", ["alpha", "beta", "gamma", "delta"]),
        ('{"predicted_molecules": ["a"', None),
        ("", None),
        (None, None),
    ],
)
def test_reply_molecules(spark, text, want):
    assert one(spark, text, G.reply_molecules) == want


def test_agent_reply(spark):
    assert one(spark, '{"molecules": ["A", "a", " "], "x": 1}', G.reply_molecules_agent) == ["A"]
    assert one(spark, '{"hypotheses": [{"predicted_molecules": []}, {"predicted_molecules": ["q"]}]}', G.reply_molecules_agent) == ["q"]
    assert one(spark, '- "p",\n- predicted: z\n- P', G.reply_molecules_agent) == ["p"]


@pytest.mark.parametrize(("text", "good"), [('{"a":1}', True), ('{"a":1} x', False), ("[1] ]", False), ("1] }", False), ('{"a":1},{"b":2}', False), ("'x'", False), ("12", True), (" [1] ", True)])
def test_strict_json(spark, text, good):
    assert one(spark, text, lambda c: G.strict_json(c).isNotNull()) is good


def test_clean_predictions(spark):
    df = spark.createDataFrame([(["B-x", " a ", "", "A", "b x", "c", "d"], ["a"], 2), (["c"], None, None), (None, [], 3)], "m array<string>, k array<string>, n bigint")
    rows = [r[0] for r in df.select(G.clean_predictions(F.col("m"), F.col("k"), F.col("n"))).collect()]
    assert rows == [["B-x", "c"], [], []]
    audit = df.select(G.final_molecules(F.col("m"), F.col("k"), F.col("n")).alias("f")).first()[0]
    assert audit["molecules"] == ["B-x", "c"] and audit["removed_partial"] == 2 and audit["removed_duplicate_or_empty"] == 2
    assert audit["truncated"] and audit["count_before_truncation"] == 3 and audit["count_before"] == 7


def test_hypotheses_and_review(spark):
    three = '{"hypotheses": [{"predicted_food": "a", "rationale": "r"}, {"predicted_food": " b "}, {"predicted_food": "c"}%s]}'
    assert [h["predicted_food"] for h in one(spark, three % "", G.hypotheses_foods)] == ["a", "b", "c"]
    assert one(spark, three % ', {"predicted_food": "d"}', G.hypotheses_foods) is None
    assert len(one(spark, three % ', {"predicted_food": ""}', G.hypotheses_foods)) == 3
    assert one(spark, '{"selected_hypothesis_index": 2, "review_reason": " x "}', G.reviewer_choice)["selected_hypothesis_index"] == 2
    for bad in ("true", "4", '"2"', "1.5", "null"):
        assert one(spark, f'{{"selected_hypothesis_index": {bad}}}', G.reviewer_choice) is None


def test_judge_replies(spark):
    assert one(spark, '{"category": "Root-Crop"}', lambda c: G.reply_category(c, ["rootcrop", "Root crop"])) == "Root crop"
    assert one(spark, '{"category": "soil"}', lambda c: G.reply_category(c, ["rootcrop"])) is None
    assert one(spark, '{"functional_groups": ["a", 1, " ", "a", "zz"]}', G.reply_groups) == ["a", "zz"]


@pytest.mark.parametrize(("value", "want"), [('["a", " ", "b"]', ["a", "b"]), ('"[\'a\', \'b\']"', ["a", "b"]), ('"[a, b]"', ["a", "b"]), ('"x"', ["x"]), ("3", None), ("[]", [])])
def test_coerce_list(spark, value, want):
    df = spark.createDataFrame([(value,)], "c string").select(F.try_parse_json("c").alias("v"))
    assert df.select(G.coerce_list(F.col("v"))).first()[0] == want
