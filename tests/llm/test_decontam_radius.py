"""Pairs at the threshold: the radius of the fingerprints loses none of them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def jaccard(a, b):
    a, b = set(shingles(a)), set(shingles(b))  # words are distinct, so are shingles
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [30, 60, 100, 200])
def test_no_pair_at_the_threshold_is_lost(spark, size):
    rng = random.Random(size)
    items = {i: [f"i{i}x{k}" for k in rng.sample(range(10**6), size)] for i in range(8)}
    docs, want = [], {}
    for d in range(64):
        i = d % 8
        w = list(items[i])
        changed = 0
        at = size
        while True:  # the last words, one more as long as the pair stays at the threshold
            at -= 1
            new = [*w[:at], f"d{d}w{at}", *w[at + 1 :]]
            if jaccard(new, items[i]) < 0.8:
                break
            w, changed = new, changed + 1
        assert changed
        fill = [f"f{rng.randrange(10**6)}" for _ in range(20)]
        docs.append((d, " ".join([*fill, *w, *fill])))
        want[d, i] = jaccard(w, items[i])
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(rows, bench).collect()}
    assert set(got) == set(want) and all(got[k] >= want[k] - 1e-9 for k in want)


def test_every_fingerprint_within_the_radius_is_looked_up(spark):
    """Flip any bits within the radius: one block of the two is within the flips."""
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        code = rng.getrandbits(64)
        other = code
        for b in rng.sample(range(64), rng.randint(0, decontam.RADIUS)):
            other ^= 1 << b
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (code, other)))
    df = spark.createDataFrame(rows, "a long, b long")
    apart = [F.bit_count(decontam._block(F.col("a"), F.lit(k)).bitwiseXOR(decontam._block(F.col("b"), F.lit(k)))) for k in range(len(decontam.BLOCKS))]
    got = df.select(F.least(*apart).alias("least"), sum(apart).alias("all"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("want")).collect()
    assert all(r.least <= decontam.FLIPS and r["all"] == r.want for r in got)
    assert sum(decontam.BLOCKS) == 64
