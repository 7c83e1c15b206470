"""Collocations against a plain rewrite, with sketches of every fullness."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i : i + k])] += 1
    return n, f


def plain_rewrite(rows, least, top):
    n, f = plain_counts(rows)
    cand = {p: a for p, a in f.items() if " " in p[1] and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner = (lang, " ".join(w[i : i + m]))
                if 100 * a >= 80 * f[inner]:
                    gone.add(inner)
    out = []
    for lang in n:
        best = []
        for (at, p), a in cand.items():
            if at == lang and (at, p) not in gone:
                w = p.split(" ")
                cuts = [(2_000_000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                best.append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "é", "日本", "x\x00y", "a-b", "É"]
    made = []
    for i in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(0, 40)))
        made.append((r.choice(["en", "fr", None, "und"]), t + r.choice(["", "new york city council"])))
    return [*made, ("en", None), (None, ""), ("xx", "   "), ("yy", "one"), ("en", "long winding road " * 4000)]


@pytest.mark.parametrize("bits", [3, 9, 22])
def test_equals_the_plain_rewrite(spark, bits):
    """With 8 cells all phrases survive, with 2**22 hardly any but the frequent ones; the result is the same."""
    rows = texts(150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(docs, least=5, top=20, bits=bits).collect())
    assert got == plain_rewrite(rows, 5, 20) and len(got) > 40


def test_merging_in_steps_and_flushing_early(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 4)
    monkeypatch.setattr(collocations, "PENDING", 1)
    monkeypatch.setattr(collocations, "ENTRIES", 1)
    monkeypatch.setattr(collocations, "SLICE", 2000)
    rows = texts(120, 2)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert sorted(tuple(r) for r in collocations.mine(docs, least=4, top=50, bits=12).collect()) == plain_rewrite(rows, 4, 50)


def test_cells_are_at_least_the_counts(spark):
    """No count is underestimated: every phrase at the threshold has both its cells."""
    rows = texts(100, 3)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("text", F.col("text").cast("binary"))
    kept = collocations.counts(docs, Scratch(spark, "t"), 6, 10).filter("size > 0").collect()
    _, f = plain_counts(rows)
    assert {(r.lang, r.phrase): r.f for r in kept} == {p: a for p, a in f.items() if a >= 6}


def test_empty_clashing_and_repeated(spark):
    docs = spark.createDataFrame([("en", "a b", 1, 2)] * 40 + [(None, "c d", 1, 2)] * 40, "lang string, text string, phrase int, N int")
    got = sorted(tuple(r) for r in collocations.mine(docs, bits=12).collect())
    assert got == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000), ("und", 1, "c d", 40, 40, 40, 80, 1_000_000)]
    assert collocations.mine(docs.limit(0), bits=12).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 3)], "lang string, size int, phrase string, f long")
    (row,) = collocations.scored(found).collect()
    assert row.score == 2_000_000 * (big - 3) // (2 * big + 1)


def test_packing_round_trip():
    r = np.random.default_rng(0)
    cells = np.unique(r.integers(0, 1 << 20, 5000)).astype(np.uint32)
    counts = r.integers(1, 1 << 20, len(cells))
    a, b = collocations._unpack(collocations._pack(cells, counts))
    assert (a == cells).all() and (b == np.minimum(counts, 65535)).all()
