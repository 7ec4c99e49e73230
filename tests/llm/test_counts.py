import json
import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from palatine.llm import cooccur, format_dups, queries


def test_cooccurrence(spark):
    rng = random.Random(2)
    baskets = [sorted(rng.sample("abcdefghij", rng.randint(0, 8))) for _ in range(300)] + [["hot", "a"]] * 150
    df = spark.createDataFrame([(b,) for b in baskets] + [(None,)], "items array<string>")
    n1, n2 = Counter(x for b in baskets for x in b), Counter(p for b in baskets for p in combinations(b, 2))
    total = sum(1 for b in baskets if b)
    got = {(r.item_a, r.item_b): r for r in cooccur.cooccurrence(df).collect()}
    assert {k: r.n_ab for k, r in got.items()} == {tuple(sorted(k)): v for k, v in n2.items()}
    r = got["a", "hot"]
    assert (r.n_a, r.n_b, r.n) == (n1["a"], n1["hot"], total)
    table = [[r.n_ab, r.n_a - r.n_ab], [r.n_b - r.n_ab, total - r.n_a - r.n_b + r.n_ab]]
    rows, cols = [sum(x) for x in table], [sum(x) for x in zip(*table)]
    g2 = 2 * sum(table[i][j] * math.log(table[i][j] * total / rows[i] / cols[j]) for i in (0, 1) for j in (0, 1) if table[i][j])
    assert math.isclose(r.llr, g2, rel_tol=1e-9)
    few = cooccur.cooccurrence(df, min_count=40)
    assert {(r.item_a, r.item_b) for r in few.collect()} == {tuple(sorted(k)) for k, v in n2.items() if v >= 40}


def test_stripes_flush(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "stripe_batches", lambda keep, hot, f=cooccur.stripe_batches: f(keep, held=3, chunk=2, hot=hot))
    df = spark.createDataFrame([(["a", "b", "c", "d"],)] * 5, "items array<string>")
    assert {r.n_ab for r in cooccur.cooccurrence(df).collect()} == {5} and cooccur.cooccurrence(df).count() == 6


def test_cooccurrence_long_and_empty(spark):
    long = spark.createDataFrame([([f"i{k:05d}" for k in range(2100)],)], "items array<string>")
    assert cooccur.cooccurrence(long).count() == 2100 * 2099 // 2
    assert cooccur.cooccurrence(spark.createDataFrame([], "items array<string>")).count() == 0
    assert cooccur.cooccurrence(spark.createDataFrame([(["a"],)], "items array<string>")).count() == 0


def test_every_pair_comes_out(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b"],)] * 5 + [(["a", "c"],)], "items array<string>")
    monkeypatch.setattr(queries, "_baskets", lambda s, d: df)
    assert {(r.molecule_a, r.molecule_b, r.n_ab) for r in queries.queries()["p5_pairs"](spark, "").collect()} == {("a", "b", 5), ("a", "c", 1)}


LINES = [
    ("a", '{"id": "x-1", "f": "Black Currant"}'),
    ("b", '\t{"f":"blackcurrant","id":"X1"}\r'),
    ("c", '{"id": "x1", "f": "black currant", "g": ""}'),
    ("d", '{"id": "x1", "f": "black curr'),
    ("e", "[1]"),
    ("f", "{'id': 'x1', 'f': 'blackcurrant'}"),
    ("g", '{"id": "x1", "f": null}'),
    ("h", '{"id": "x1", "f": ""}'),
    ("i", '{"f": "zzz", "id": "x1", "f": "BLACK-CURRANT"} '),
    ("j", None),
    ("k", '{"id": "x1", "f": "blackcurrant"} trailing'),
    ("b", '\t{"f":"blackcurrant","id":"X1"}\r'),
]


def test_format_duplicates(spark):
    members = format_dups.keyed(spark.createDataFrame(LINES, "k string, raw string"), "line", "k", format_dups.canonical_json("raw"))
    ledger = format_dups.merge_ledger(None, format_dups.batch_counts(members))
    assert {tuple(r) for r in format_dups.copies(members, ledger).collect()} == {("a", "b"), ("a", "i")}
    assert {r.first_key: r.copies for r in ledger.collect()} == {"a": 3, "c": 1, "g": 1, "h": 1}


def test_columns_and_hot_group(spark):
    rows = [(f"e{i:04d}", "A b", "x") for i in range(400)] + [("n1", None, "x"), ("n2", None, "X "), ("m", "", "x"), (None, "q", "q")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    members = format_dups.keyed(df, "c", "k", format_dups.canonical_columns("a", "b"))
    got = {tuple(r) for r in format_dups.copies(members, format_dups.batch_counts(members)).collect()}
    assert got == {("e0000", f"e{i:04d}") for i in range(1, 400)} | {("n1", "n2")}


def test_ledger_on_disk(spark, tmp_path):
    def batch(*pairs):
        df = spark.createDataFrame(list(pairs), "k string, a string")
        return format_dups.batch_counts(format_dups.keyed(df, "c", "k", format_dups.canonical_columns("a"), buckets=4))

    ledger = format_dups.KeyLedger(spark, str(tmp_path / "ledger"))
    ledger.update(batch(("k5", "Fig"), ("k6", "pear")))
    ledger.update(batch(("k1", "f i g"), ("k9", "PEAR!"), ("k7", "plum")))
    ledger.update(batch().limit(0))
    got = {r.first_key: r.copies for r in ledger.read().select("first_key", "copies").collect()}
    assert got == {"k1": 2, "k6": 2, "k7": 1}


def test_ledger_takes_a_batch_once(spark, tmp_path):
    """A batch delivered again changes nothing; an update that dies before its pointer leaves the ledger as it was."""
    rows = spark.createDataFrame([("k1", "Fig"), ("k2", "fig")], "k string, a string")
    counts = format_dups.batch_counts(format_dups.keyed(rows, "c", "k", format_dups.canonical_columns("a")))
    ledger = format_dups.KeyLedger(spark, str(tmp_path / "ledger"))
    assert ledger.update(counts, 1) and not ledger.update(counts, 1)
    assert [tuple(r) for r in ledger.read().select("first_key", "copies").collect()] == [("k1", 2)]
    (tmp_path / "ledger" / "v-half").mkdir()
    assert [r.copies for r in format_dups.KeyLedger(spark, str(tmp_path / "ledger")).read().collect()] == [2]
    assert ledger.update(counts, 2) and [r.copies for r in ledger.read().collect()] == [4]
    for k in range(3, 6):
        ledger.update(counts, k)
    assert sum(p.name.startswith("v-") for p in (tmp_path / "ledger").iterdir()) == 2 and ledger.read().first().copies == 10


def test_both_parsers_give_one_form(spark):
    """Lines that the built-in parser takes have the canonical form that Python's gives."""
    df = spark.createDataFrame([(k, r) for k, r in LINES if k != "b"] + [("z", '{"a b": [1, "x"], "q": true, "u": "\\u00c9 2"}')], "k string, raw string")
    for r in format_dups.canonical_lines(df, "raw").collect():
        assert r["_c"] == format_dups._canonical(r.raw)


def test_significance_keeps_what_the_thresholds_keep():
    """Five baskets and threefold chance always reach the ratio."""
    g2 = lambda ab, a, b, n: 2 * sum(x * math.log(x * n / r / c) for x, r, c in ((ab, a, b), (a - ab, a, n - b), (b - ab, n - a, b), (n - a - b + ab, n - a, n - b)) if x)
    rng = random.Random(3)
    for _ in range(20_000):
        n = rng.randint(20, 3000)
        ab = rng.randint(5, 30)
        a, b = ab + rng.randint(0, 60), ab + rng.randint(0, 60)
        if a + b - ab <= n and ab * n >= 3 * a * b:
            assert g2(ab, a, b, n) >= cooccur.SIGNIFICANT


def test_hot_items_and_many_items(spark, monkeypatch):
    """Stripes in parts, and pruning by a join, give the same counts."""
    rng = random.Random(8)
    df = spark.createDataFrame([(sorted({"hot", *rng.sample("abcdefghijklmnop", 5)}),) for _ in range(200)], "items array<string>")
    want = sorted(map(tuple, cooccur.cooccurrence(df, min_count=20).collect()))
    monkeypatch.setattr(cooccur, "HOT_SHARE", 4)
    monkeypatch.setattr(cooccur, "PRUNE_ITEMS", 3)
    assert sorted(map(tuple, cooccur.cooccurrence(df, min_count=20).collect())) == want and want


def test_canonical_form_ignores_order_only():
    a = format_dups._canonical(json.dumps({"b": "X y", "a": 1}))
    assert a == format_dups._canonical('{"a": 1, "b": "xY"}') != format_dups._canonical('{"a": 2, "b": "xY"}')
    assert format_dups._canonical("[" * 100_000) is None


def test_empty_lines(spark):
    members = format_dups.keyed(spark.createDataFrame([], "k string, raw string"), "line", "k", format_dups.canonical_json(F.col("raw")))
    assert format_dups.copies(members, format_dups.batch_counts(members)).count() == 0
