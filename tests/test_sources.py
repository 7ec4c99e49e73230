import json

import pytest

from palatine.sources import jsonl, sinks, tables
from palatine.streaming.upsert import folder_stream, upsert_stream


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"id": 1, "v": "a"}\n\n{"id": "2", "v": null}\nnot json\n[1]\n{"v": "c"}\n', encoding="utf-8")
    return str(p)


def test_policies(spark, lines):
    rows = jsonl.read_jsonl(spark, lines, "id string, v string", "skip").orderBy("ord").collect()
    assert [(r.id, r.v) for r in rows] == [("1", "a"), ("2", None), (None, "c")]
    counted = jsonl.read_jsonl(spark, lines, "id string, v string", "count")
    assert counted.count() == 5 and jsonl.bad_lines(counted) == 2
    with pytest.raises(Exception, match="bad JSON object"):
        jsonl.read_jsonl(spark, lines, "id string, v string").collect()
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, lines, "id string", "guess")


def test_required_id(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"v": 1}\n')
    with pytest.raises(Exception, match="row without id"):
        jsonl.read_jsonl(spark, str(p), "id string, v int", require_id=True).collect()


def test_prediction_scans(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    rows = [
        {"id": 1, "predicted_food": " [Apple]* "},
        {"id": "1", "predicted_food": "**"},
        {"id": 2, "prediction": "Pear"},
        {"id": 3, "predicted_food": None, "prediction": "Fig"},
        {"predicted_food": "Plum"},
        {"id": 1, "predicted_food": "Apple pie"},
    ]
    p.write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    got = jsonl.food_predictions(jsonl.scan_lines(spark, str(p)))
    assert {r.id: r.predicted_food for r in jsonl.last_success(got, "predicted_food").collect()} == {"1": "Apple pie", "2": "Pear"}
    assert {r.id for r in jsonl.failed_ids(got).collect()} == {"1", "3"}
    m = tmp_path / "m.jsonl"
    m.write_text('{"id": 1, "predicted_molecules": []}\n{"id": 2, "predicted_molecules": "[\'a\', \'b\']"}\n{"id": 3, "predicted_molecules": ["a"], "error": "x"}\n{"id": 4, "predicted_molecules": 5}\n')
    got = jsonl.molecule_predictions(jsonl.scan_lines(spark, str(m)))
    assert {r.id: r.predicted_molecules for r in jsonl.last_success(got, "predicted_molecules").collect()} == {"1": [], "2": ["a", "b"]}
    assert {r.id for r in jsonl.failed_ids(got).collect()} == {"3", "4"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    sinks.write_jsonl(df, str(tmp_path / "o"))
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "o").glob("part-*"))
    assert json.loads(text) == {"a": "é", "b": None} and "é" in text
    sinks.write_document(df, str(tmp_path / "doc.json"))
    assert json.loads((tmp_path / "doc.json").read_text(encoding="utf-8"))["a"] == "é"
    with pytest.raises(FileExistsError):
        sinks.guard_output(spark, str(tmp_path / "o"))
    sinks.guard_output(spark, str(tmp_path / "o"), resume=True)


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame(list(r), "id string, v int, ord bigint")
    sinks.upsert_table(row(("a", 1, 0), ("b", 1, 1), ("a", 2, 2)), path)
    sinks.upsert_table(row(("c", 3, 0), ("b", 9, 1)), path)
    got = [(r.id, r.v) for r in spark.read.parquet(path).orderBy("ord").collect()]
    assert got == [("a", 2), ("b", 9), ("c", 3)]


def test_replacement_that_died_half_way(spark, tmp_path):
    path = tmp_path / "t"
    row = lambda *r: spark.createDataFrame(list(r), "id string, v int, ord bigint")
    sinks.upsert_table(row(("a", 1, 0)), str(path))
    path.rename(tmp_path / "t.aside")  # dies before the new version is in place
    sinks.upsert_table(row(("b", 2, 0)), str(path))
    assert {r.id for r in spark.read.parquet(str(path)).collect()} == {"a", "b"} and not (tmp_path / "t.aside").exists()


def test_cache_is_written_over_itself(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda *r: spark.createDataFrame(list(r), "food string, category string")
    sinks.write_cache(None, row(("fig", "fruit"), ("beet", "root")), path, "food")
    sinks.write_cache(spark.read.parquet(path), row(("fig", "dry fruit"), ("ale", "drink")), path, "food")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("ale", "drink"), ("beet", "root"), ("fig", "dry fruit")]


def test_stream_upsert(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "v": 1, "ord": 0}\n{"id": "b", "v": 1, "ord": 1}\n')
    args = (str(tmp_path / "table"), str(tmp_path / "ck"))
    upsert_stream(folder_stream(spark, str(src), "id string, v int, ord bigint"), *args).awaitTermination()
    (src / "2.json").write_text('{"id": "a", "v": 7, "ord": 0}\n')
    upsert_stream(folder_stream(spark, str(src), "id string, v int, ord bigint"), *args).awaitTermination()
    assert {r.id: r.v for r in spark.read.parquet(args[0]).collect()} == {"a": 7, "b": 1}


def test_cache_identity(spark, tmp_path):
    path, who = str(tmp_path / "cache"), {"model": "m", "prompt_version": "1"}
    with pytest.raises(sinks.IdentityMismatch):
        sinks.bind_cache(spark, path, who, empty=False)
    sinks.bind_cache(spark, path, who, empty=True)
    sinks.bind_cache(spark, path, who, empty=False)
    with pytest.raises(sinks.IdentityMismatch):
        sinks.bind_cache(spark, path, who | {"model": "n"}, empty=False)


def test_lookup_tables(spark):
    foods = spark.createDataFrame([(1, "Apple", "fruit-a"), (2, "Apple", "tree-b"), (3, None, "x"), (4, "Fig", "")], "entity_id bigint, entity_alias_readable string, category string")
    assert [tuple(r) for r in tables.food_categories(foods).collect()] == [("Apple", "tree")]
    cache = spark.createDataFrame([("1", "Black  Currant", "Berry fruit"), ("2", "fig", "nothing")], "entry_key string, food_key string, category string")
    words = spark.createDataFrame([("berryfruit",)], "category string")
    assert [tuple(r) for r in tables.category_cache(cache, words).collect()] == [("black currant", "berryfruit")]
    ev = spark.createDataFrame([("A b", '["x", {"k": 1}]'), ("c", '{"k": 2}'), ("d", "null"), ("e", "5")], "k string, v string")
    got = {(r.key, r.pos): r.snippet for r in tables.evidence_rows(ev, "k", "v").collect()}
    assert got == {("A b", 0): "x", ("A b", 1): '{"k":1}', ("c", 0): '{"k":2}', ("e", 0): "5"}
    assert tables.quoted('a"b') == '"a""b"'
    assert tables.pick_column(foods, "id", "entity_id") == "entity_id"
