import json
import random

import pytest

from palatine.__main__ import main
from palatine.sources import env


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def read(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def tasks(tmp_path):
    rows = [{"id": i, "task": "MFP", "actual_food": f"food {i}", "molecules": [f"m{i % 5}", f"m{i % 3}x"]} for i in range(20)]
    return write(tmp_path / "tasks.jsonl", rows), rows


def test_split_and_retrieve(spark, tmp_path, tasks, capsys):
    path, rows = tasks
    out = tmp_path / "splits"
    assert main(["split", "--input", path, "--output", str(out)]) == 0
    want = list(range(20))
    random.Random(42).shuffle(want)
    got = {n: [int(r["id"]) for r in read(out / f"{n}.jsonl")] for n in ("train", "dev", "test")}
    assert got["train"] + got["dev"] + got["test"] == want and len(got["test"]) == 2
    assert main(["check", str(out / "train.jsonl")]) == 0
    args = ["--train", str(out / "train.jsonl"), "--test", str(out / "test.jsonl"), "--output", str(tmp_path / "demos")]
    assert main(["retrieve", *args]) == 0
    assert all(len(r["retrieved"]) == 3 for r in read(tmp_path / "demos"))
    assert main(["retrieve", "--train", path, "--test", path, "--output", str(tmp_path / "no")]) == 1
    assert "is in both parts" in capsys.readouterr().err


def test_hash_split(spark, tmp_path, tasks):
    assert main(["split", "--input", tasks[0], "--output", str(tmp_path / "h"), "--hash"]) == 0
    assert sorted(int(r["id"]) for n in ("train", "dev", "test") for r in read(tmp_path / "h" / f"{n}.jsonl")) == list(range(20))


def test_check_fails_on_bad_lines(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    assert main(["check", str(tmp_path / "bad.jsonl")]) == 1
    assert main(["check", str(tmp_path / "none.jsonl")]) == 1


def test_reconstruct(spark, tmp_path):
    def parquet(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path / f"{name}.parquet")

    foods = parquet("foods", [(1, "Fig")], "entity_id bigint, entity_alias_readable string")
    mols = parquet("mols", [(1, "b"), (2, "A"), (3, "c")], "id bigint, common_name string")
    links = parquet("links", [(1, 1), (1, 2), (1, 3)], "entity_id bigint, molecule_id bigint")
    base = ["reconstruct", "--foods", foods, "--molecules", mols, "--links", links]
    good = write(tmp_path / "raw.jsonl", [{"id": 7, "task": "MPC", "food": "fig", "missing_molecules": ["B"]}])
    assert main([*base, "--tasks", good, "--output", str(tmp_path / "out")]) == 0
    assert read(tmp_path / "out") == [{"id": "7", "task": "MPC", "target_food": "fig", "partial_molecules": ["A", "c"], "n": 1, "missing_molecules": ["B"]}]
    bad = write(tmp_path / "bad.jsonl", [{"id": 7, "task": "MPC", "food": "nothing", "missing_molecules": ["B"]}])
    assert main([*base, "--tasks", bad, "--output", str(tmp_path / "out2")]) == 1 and not (tmp_path / "out2").exists()


def test_evaluate(spark, tmp_path):
    gold = write(tmp_path / "gold.jsonl", [{"id": 1, "actual_food": "Fig"}, {"id": 2, "actual_food": "Fig"}])
    pred = write(tmp_path / "pred.jsonl", [{"id": "1", "predicted_food": "[Pear]"}, {"id": 2, "predicted_food": ""}])
    for name, rows, schema in (
        ("foods", [(1, "Fig", "fruit-x")], "entity_id bigint, entity_alias_readable string, category string"),
        ("cache", [("1", "pear", "Fruit")], "entry_key string, food_key string, category string"),
        ("words", [("fruit",)], "category string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    p = lambda n: str(tmp_path / f"{n}.parquet")
    assert main(["evaluate", "--gold", gold, "--predictions", pred, "--reference", p("foods"), "--cache", p("cache"), "--vocabulary", p("words"), "--output", str(tmp_path / "e")]) == 0
    summary = json.loads((tmp_path / "e" / "evaluation_summary.json").read_text())
    assert summary["accuracy"] == 0.5 and summary["parse_failed"] == 1


def judge(calls):
    """Made within a function, so that it travels to the workers by value."""

    class Judge:
        """A stand-in for the chat client; it answers by rule and counts its calls in a file."""

        url, model, options = "http://none", "stub", {}

        def __init__(self, calls):
            self.calls = calls

        def __call__(self, messages, options=None):
            from palatine.operators.model import Reply

            with open(self.calls, "a") as f:
                f.write("x")
            text = messages[-1]["content"]
            if "hypotheses" in text and "selected_hypothesis_index" not in text:
                return Reply(json.dumps({"hypotheses": [{"predicted_food": f, "rationale": "r"} for f in ("Fig", "Pear", "Plum")]}))
            if "selected_hypothesis_index" in text:
                return Reply("nothing" if "fail" in open(self.calls + ".mode").read() else json.dumps({"selected_hypothesis_index": 2, "review_reason": "r"}))
            return Reply(json.dumps({"category": "FRUIT" if "pear" in text.lower() else "unlisted"}))

    return Judge(calls)


@pytest.fixture
def stub(tmp_path, monkeypatch):
    calls = str(tmp_path / "calls")
    open(calls, "w").close(), open(calls + ".mode", "w").close()
    monkeypatch.setattr("palatine.__main__._client", lambda a: judge(calls))
    return lambda: len(open(calls).read())


def test_evaluate_asks_the_judge_once(spark, tmp_path, stub):
    gold = write(tmp_path / "gold.jsonl", [{"id": i, "actual_food": "Fig"} for i in (1, 2, 3)])
    pred = write(tmp_path / "pred.jsonl", [{"id": "1", "predicted_food": "Pear"}, {"id": 2, "predicted_food": " PEAR "}, {"id": 3, "predicted_food": "Rock"}])
    spark.createDataFrame([(1, "Fig", "fruit-x")], "entity_id bigint, entity_alias_readable string, category string").write.parquet(str(tmp_path / "foods.parquet"))
    spark.createDataFrame([("fruit",)], "category string").write.parquet(str(tmp_path / "words.parquet"))
    args = ["evaluate", "--gold", gold, "--predictions", pred, "--reference", str(tmp_path / "foods.parquet"), "--cache", str(tmp_path / "cache.parquet"), "--vocabulary", str(tmp_path / "words.parquet"), "--output", str(tmp_path / "e"), "--use-llm"]
    assert main(args) == 0
    summary = json.loads((tmp_path / "e" / "evaluation_summary.json").read_text())
    assert summary["correct"] == 2 and summary["llm_mapping_failed"] == 1 and stub() == 2
    assert main(args) == 0 and stub() == 3  # only the failure is asked again
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "cache.parquet")).select("food_key", "category").collect()] == [("pear", "fruit")]


def test_agent_resumes_by_stage(spark, tmp_path, stub):
    """Hypotheses of a run whose review failed are not asked for again; failures are redone in place."""
    train = write(tmp_path / "train.jsonl", [{"id": f"t{i}", "task": "MFP", "actual_food": f"food {i}", "molecules": [f"m{i}", "m"]} for i in range(4)])
    test = write(tmp_path / "test.jsonl", [{"id": i, "task": "MFP", "actual_food": "x", "molecules": ["m", f"m{i}"]} for i in range(2)])
    spark.createDataFrame([("m", 1, "sweet")], "key string, pos int, snippet string").write.parquet(str(tmp_path / "ev.parquet"))
    args = ["predict", "--method", "agent", "--train", train, "--test", test, "--evidence", str(tmp_path / "ev.parquet"), "--output", str(tmp_path / "out"), "--hypotheses", str(tmp_path / "hyp"), "--retrieval", str(tmp_path / "demos")]
    (tmp_path / "calls.mode").write_text("fail")
    assert main(args) == 0 and stub() == 4
    (tmp_path / "calls.mode").write_text("")
    assert main([*args, "--retry-errors"]) == 0 and stub() == 6
    got = {r.id: (r.predicted_food, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0": ("Pear", None), "1": ("Pear", None)}
    assert main([*args, "--resume"]) == 0 and stub() == 6


def test_api_config(spark, monkeypatch, capsys):
    monkeypatch.setenv("PAL_KEY_X", "secret")
    assert main(["api-config", "--key-env", "PAL_KEY_X"]) == 0
    out = capsys.readouterr().out
    assert '"found": true' in out and "secret" not in out


def test_settings(tmp_path, monkeypatch):
    text = "# c\nexport A='x y'\nB = \"2\"\nnonsense\n=3\nC=\n"
    assert env.parse_settings(text) == {"A": "x y", "B": "2", "C": ""}
    (tmp_path / ".env.local").write_text("PAL_T1=file\nPAL_T2=file\n")
    monkeypatch.setenv("PAL_T1", "real")
    monkeypatch.setenv("PAL_T2", "x")
    monkeypatch.delenv("PAL_T2")
    assert env.load_settings(str(tmp_path / "none"), str(tmp_path)) == {"PAL_T2": "file"}
    assert env.resolve(None, "", "b", default="d") == "b" and env.resolve(None, default="d") == "d"
    with pytest.raises(LookupError):
        env.resolve(None)
