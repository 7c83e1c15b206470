"""The extendible-hash index against a plain rewrite, with keys narrow enough to collide."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm import exact_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_rewrite(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in by.items():
        keep = max(ids)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out)


def table(spark, rows, parts=7):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")


def some(n, seed=3):
    r = random.Random(seed)
    texts = [" ".join(r.choice(("Alpha", "beta", "É", "ß", "日本")) for _ in range(r.randrange(0, 4))) for _ in range(n)]
    return list(enumerate([t.upper() if r.random() < 0.2 else t for t in texts] + [None, "", "HOT"] + ["hot"] * (n // 2)))


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_equals_the_plain_rewrite(spark, bits):
    """Three key bits give eight chains of many texts; a bucket limit of 100 bytes splits, four heads force pieces."""
    rows = some(300)
    got = exact_dedup.groups(table(spark, rows), key_bits=bits, bucket_bytes=100, many=4).collect()
    assert sorted(tuple(r) for r in got) == plain_rewrite(rows)


def test_forgotten_texts_are_found_by_the_owners(spark, monkeypatch):
    """A task that keeps no texts makes a representative of every row of a later slice; the owners join them."""
    rows = [(i, f"copy {i % 5} " * 50) for i in range(400)]
    monkeypatch.setattr(exact_dedup, "SEEN_BYTES", 0)
    got = exact_dedup.groups(table(spark, rows, 2)).collect()
    assert sorted(tuple(r) for r in got) == plain_rewrite(rows)


def test_directory_splits_only_full_buckets(spark):
    keys = [(k << 60, 2, 10) for k in range(-8, 8)] + [((-8 << 60) + (j << 52), 2, 1000) for j in (1, 2)]
    made = exact_dedup.directory(spark.createDataFrame(keys, "key long, reps long, bytes long"), Scratch(spark, "t"), limit=1000)
    rows = made.withColumn("depth", F.length(F.conv(F.col("bucket").cast("string"), 10, 2)) - 1).collect()
    assert len(rows) == len(keys)
    deep = {r.key: r.depth for r in rows}
    assert max(deep.values()) == 12 and min(deep.values()) == 3  # the two heavy keys differ in their eleventh bit only, the third one in the twelfth
    assert sum(d > 5 for d in deep.values()) <= 3


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(None, "a"), (None, "A"), (5, "b"), (5, "B"), (5, "c"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, exact_id int, REP string")
    got = exact_dedup.groups(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (5, 5, 1, True), (5, 5, 2, False), (5, 5, 2, True), (7, 8, 2, False), (8, 8, 2, True),
    ]
    left = exact_dedup.clean(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in left.collect()) == [(0, "a"), (5, "b"), (5, "c"), (8, "")]
    assert exact_dedup.groups(docs.limit(0)).count() == 0 == exact_dedup.clean(docs.limit(0)).count()


def test_only_ascii_letters_are_folded(spark):
    rows = [(1, "É"), (2, "é"), (3, "K"), (4, "k"), (5, "K"), (6, "long " * 100000), (7, "LONG " * 100000)]
    assert sorted(tuple(r) for r in exact_dedup.groups(table(spark, rows)).collect()) == plain_rewrite(rows)
