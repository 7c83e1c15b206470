"""Known surfaces: texts are counted where their ids are dealt, at any size of the lexicon."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import checkpoints
from lodestone.functions import chunks

TEXTS = [(i, ["a"] + [f"w{i % 7}", f"w{i % 3}"] * (i % 4)) for i in range(400)] + [(5, ["a", "w1"]), (None, ["a"]), (900, None), (901, [])]
LEXICON = [("a", "x"), ("a", "y"), ("w1", "x"), ("w1 w1", "z"), ("a w2", "z"), ("none", "x")]


def _found(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, t array<string>")
    return chunks.surfaces(docs, spark.createDataFrame(LEXICON, "surface string, entity string"), 2, F.col("t"))


def _want():
    n = Counter()
    for i, t in TEXTS:
        grams = [" ".join(t[k : k + m]) for m in (1, 2) for k in range(len(t) - m + 1)] if t else []
        n.update((i, e) for g in grams for s, e in LEXICON if s == g)
    return {(i, e, c) for (i, e), c in n.items()}


def test_texts_are_dealt_once_by_id(spark):
    found = _found(spark)
    assert {tuple(r) for r in found.collect()} == _want()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(surface" not in plan and "hashpartitioning(doc_id" in plan


@pytest.mark.parametrize("rows", [64, 1 << 20])
def test_a_task_has_a_bounded_number_of_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(checkpoints, "ROWS", rows)
    texts = _found(spark).select("doc_id").distinct().groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert rows > 64 or texts <= rows


@pytest.mark.parametrize("rows", [50, 1 << 20])
def test_a_lexicon_that_is_dealt_gives_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(checkpoints, "ROWS", rows)
    monkeypatch.setattr(chunks, "ROWS", rows)  # with 50, "a" and others stand in more places
    monkeypatch.setattr(chunks, "SMALL", 0)
    assert {tuple(r) for r in _found(spark).collect()} == _want()
