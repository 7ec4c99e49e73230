import re

import pytest
from pyspark.sql import functions as F

from palatine.functions import normalize as N

TEXTS = ["Café-au_lait", "Ethyl 2-methyl", "(E)-2-Nonenal", "x²", "a b", "", "  \tA  b\n", "ÜBER__maß", "---", None, "É é\x1cz", "[Apple]*"]


NAMES = ["café au lait", "ethyl 2 methyl", "e 2 nonenal", "x²", "a b", "", "a b", "über maß", "", "", "é é z", "apple"]


def values(spark, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def test_name_text(spark):
    assert values(spark, N.name_text) == NAMES


def test_surface_and_compact(spark):
    want = [" ".join(str(t).strip().lower().split()) for t in TEXTS]
    assert values(spark, N.surface_text) == want
    assert values(spark, N.compact_text) == [w.replace(" ", "").replace("-", "").replace("_", "") for w in want]


def test_strip_and_clean(spark):
    assert values(spark, N.strip) == [None if t is None else t.strip() for t in TEXTS]
    assert values(spark, N.clean_prediction) == [None if t is None else re.sub(r"[\[\]*]", "", t).strip() for t in TEXTS]


def test_tokens(spark):
    assert values(spark, N.tokens) == [[x for x in re.split(r"[^0-9A-Za-z]+", (t or "").lower()) if x] for t in TEXTS]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", [""]), (None, [""]), ("a b", ["a", "b"]), ("a  b", ["a", "", "b"]), ("x@compound", ["compound"]), ("primary@y", ["primary"]), ("primary@compound", ["compound", "primary"]), ("z@w", []), ("a a", ["a"])],
)
def test_functional_groups(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "g string")
    assert df.select(N.functional_groups("g")).first()[0] == want


def test_lists_and_fallbacks(spark):
    df = spark.createDataFrame([("a; b,|c ", None, ""), (None, "", "z")], "s string, p string, q string")
    rows = df.select(N.synonym_parts("s"), N.first_truthy("p", "q", F.lit("end")), N.category_head(F.lit("root-wild-x"))).collect()
    assert rows[0][0] == ["a", "b", "c"] and rows[1][0] == []
    assert [r[1] for r in rows] == ["end", "z"] and rows[0][2] == "root"
