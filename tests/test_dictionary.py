"""The stored dictionary against all pairs and plain lookups."""

import random

import pytest

from lodestone.functions import dictionary


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2])
def test_fuzzy_equals_all_pairs(spark, k):
    """Short, empty and long words (past the prefix), edits at both ends and shifts."""
    r = random.Random(k)
    words = {"", "a", "ab", "ba", "é", "日本"} | {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)}
    stem = "abcdefghijklmnopqrst"
    words |= {stem, stem[1:], stem[2:] + "xy", "xy" + stem[:-2], "x" + stem, stem[:5] + "é" + stem[6:], stem + "z"}
    terms = spark.createDataFrame([(w, len(w)) for w in sorted(words)] + [(None, 1)], "term string, value int").dropna()
    asked = sorted(words)[::3] + [stem, None, "zzzzzz"]
    got = dictionary.fuzzy(terms, spark.createDataFrame([(q,) for q in asked], "query string"), k).collect()
    want = {(q, w, len(w), e) for q in asked if q is not None for w in words if (e := edits(q, w)) <= k}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_lookups_and_merges(spark, tmp_path):
    a = spark.createDataFrame([("b", 2), ("a", 1), ("b", 5), (None, 9), ("ba", 3), ("c", 1)], "term string, value int")
    path = str(tmp_path / "d")
    dictionary.build(a, path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(dictionary.exact(spark, path, "b")) == [("b", 7)]
    assert rows(dictionary.prefix(spark, path, "b")) == [("b", 7), ("ba", 3)]
    assert rows(dictionary.between(spark, path, "a", "ba")) == [("a", 1), ("b", 7)]
    assert dictionary.ends(spark, path).first() == ("a", "c")
    assert rows(dictionary.merged(a, a, how="min")) == [("a", 1), ("b", 2), ("ba", 3), ("c", 1)]
    assert rows(dictionary.merged(a, a, how="max")) == [("a", 1), ("b", 5), ("ba", 3), ("c", 1)]
    with pytest.raises(ValueError):
        dictionary.merged(a, how="first")
    assert dictionary.fuzzy(a.limit(0), spark.createDataFrame([("a",)], "query string")).count() == 0
