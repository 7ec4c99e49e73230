import random
from collections import Counter, defaultdict

import pytest

from palatine.llm import canonical_map, group_split


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_pigeonhole_finds_every_near_key(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    refs = sorted({word(rng.randint(3, 12)) for _ in range(120)})
    values = sorted({word(rng.randint(1, 13)) for _ in range(250)} | {r[:-1] for r in refs[:20]})
    got = canonical_map.mapped_values(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(list(zip(refs, range(len(refs)))), "name string, canon_id bigint"))
    want = {}
    for v in values:
        near = [(d, i) for i, r in enumerate(refs) if (d := distance(v, r)) <= min(2, len(r) // 3)]
        want[v] = min(near)[1] if near else -1
    assert {r.value: r.canon_id for r in got.collect()} == want


def test_forms(spark):
    refs = spark.createDataFrame([("blackcurrant", 1), ("rootcrop", 2), ("", 3), (None, 4)], "name string, canon_id bigint")
    cells = ["the Black Currant (raw)", "Currant, Black", "[blak_curant]*", "crop, root", "Root Crop (main)", "unknown", "???", "Black Currant", "black currant"]
    cells += ["the root-crop", "Root Crop raw", "black currant RAW", "the blackcurrant", "Blackcurrant main", "a ripe root crop", "a ripe black currant", "A RIPE Black Curant", "ripe crop", "black crop"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cells)] + [(30, None), (31, " \t"), (32, " ")], "detail_id bigint, value string")
    listed = spark.createDataFrame([("Black Currant",), (None,)], "value string")
    got = {r.detail_id: r.canon_id for r in canonical_map.map_column(rows, refs, listed).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: -1, 6: -1, 8: 1} | {9: 2, 10: 2, 11: 1, 12: 1, 13: 1, 14: 2, 15: 1, 16: 1, 17: -1, 18: -1}


def test_own_name_goes_before_a_shorter_one(spark):
    """A value that is listed as it stands keeps its entry, though what is left without a qualifying word is listed too, with a smaller id."""
    names = spark.createDataFrame([("plum", 1), ("dried plum", 2), ("fig", 3), ("pear", 4)], "name string, canon_id bigint")
    rows = spark.createDataFrame(list(enumerate(["Dried Plum.", "fresh fig", "fresh pear", "fresh plum", "dried fig", "dried pear"])), "detail_id bigint, value string")
    got = {r.detail_id: r.canon_id for r in canonical_map.map_column(rows, names, spark.createDataFrame([], "value string")).collect()}
    assert got == {0: 2, 1: 3, 2: 4, 3: 1, 4: -1, 5: -1}


def test_empty_list_and_rows(spark):
    none = spark.createDataFrame([], "name string, canon_id bigint")
    rows = spark.createDataFrame([(1, "x"), (1, "x")], "detail_id bigint, value string")
    listed = spark.createDataFrame([], "value string")
    assert [r.canon_id for r in canonical_map.map_column(rows, none, listed).collect()] == [-1, -1]
    assert canonical_map.map_column(rows.limit(0), none, listed).count() == 0


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = defaultdict(set)
    for x in list(parent):
        out[find(x)].add(x)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("local", [1_000_000, 3])
def test_components(spark, local):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 6000 + i) for i in range(300)]
    edges = chain + star + [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 1)], "u bigint, v bigint").repartition(6)
    got = defaultdict(set)
    for r in group_split.connected_components(df, local_edges=local).collect():
        got[r.component].add(r.node)
    assert {frozenset(s) for s in got.values()} == components(edges)
    assert all(c in s for c, s in got.items())


def test_quotas_equal_plain_greedy():
    rng = random.Random(1)
    for _ in range(60):
        hist = Counter(rng.choice([1, 1, 1, 2, 3, 7, 50]) for _ in range(rng.randint(1, 400)))
        shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
        total = sum(s * n for s, n in hist.items())
        lack = {k: v * total for k, v in shares.items()}
        for s in sorted((s for s, n in hist.items() for _ in range(n)), reverse=True):
            k = max(lack, key=lack.get)
            lack[k] -= s
        want = {k: shares[k] * total - v for k, v in lack.items()}
        got = Counter()
        for size, name, lo, hi in group_split.quotas(list(hist.items()), shares):
            got[name] += size * (hi - lo)
        assert sum(got.values()) == total
        assert max(abs(got[k] - want[k]) for k in shares) <= max(hist)


def test_records_stay_together(spark):
    rows = [(f"r{i}", i % 40 if i % 3 else 999) for i in range(900)] + [("alone", None), ("both", 1), ("both", 2), (None, 3)]
    df = spark.createDataFrame(rows, "record string, entity bigint")
    got = group_split.split_records(df, {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert sorted(r.record for r in got) == sorted({r for r, _ in rows if r})
    by = defaultdict(set)
    split = {r.record: r.split for r in got}
    for r, e in rows:
        if r and e is not None:
            by[e].add(split[r])
    assert all(len(s) == 1 for s in by.values()) and by[1] == by[2]
    n = Counter(split.values())
    assert 680 <= n["train"] <= 760
    empty = spark.createDataFrame([], "record string, entity bigint")
    assert group_split.split_records(empty, {"train": 1.0}).count() == 0
