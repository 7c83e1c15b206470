"""Retrieval, statements and chunks: SQL twins on the smallest tables, and brute force where SQL cannot say it."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunks, geometry, qgram, vectors
from lodestone.operators import datalog, graph, ranking
from lodestone.plans import catalogue
from lodestone.plans import chunks as chunk_queries
from lodestone.plans import search, worlds

WHERE = "/root/testdata/sf0.001"
MODULES = {search.__name__, worlds.__name__, chunk_queries.__name__}
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ in MODULES and n in catalogue.ORACLES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{WHERE}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    got = catalogue.QUERIES[name](spark, WHERE)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


def test_substring_search_order(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick red fox"), (3, "brown fox jumps"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in qgram.search(docs, "quick fox").collect()}
    assert set(got) == {1, 2, 3} and got[3] < 0.5 * max(got.values())
    assert [r["doc_id"] for r in qgram.search(docs, '"quick brown"').collect()] == [1]


def test_overlapping_places(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.\\E") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for p in ("aa", "aba", ".", "\\E", "b"):
        for r in docs.select("t", qgram.occurrences(F.col("t"), p).alias("m")).collect():
            at = [i for i in range(len(r["t"]) - len(p) + 1) if r["t"].startswith(p, i)]
            mask = 0
            for i in at:
                mask |= 1 << min(31, i * 32 // max(1, len(r["t"])))
            assert tuple(r["m"]) == (len(at), at[0] if at else -1, mask), (p, r["t"])


def test_fielded_terms(spark):
    docs = spark.createDataFrame([(1, ["hello"], ["other"]), (2, ["other"], ["hello"])], "id long, title array<string>, body array<string>")
    got = {r["id"]: r["score"] for r in ranking.fielded(docs, ["hello"], {"title": 10.0, "body": 1.0}).collect()}
    assert got[1] > got[2] > 0


def test_nearest_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(400)] + [(400, None), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["id"]) for r in vectors.nearest(rows, rows.filter("vec_id = 0"), 3).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert vectors.nearest(rows, rows.limit(0), 3).count() == 0


def test_sign_bits_beyond_one_word(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(6, 130))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = geometry.two_stage(rows, rows.filter("vec_id = 0"), 5).collect()
    assert {r["id"]: r["hamming"] for r in got} == {i: int(((m[i] >= 0) != (m[0] >= 0)).sum()) for i in range(1, 6)}


def test_rerank_equals_greedy(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(12, 5)), rng.normal(size=5)
    unit = lambda x: x / np.linalg.norm(x)
    rel = [float(unit(x) @ unit(q)) for x in v]
    rows = spark.createDataFrame([(0, i, rel[i], [float(y) for y in v[i]], i) for i in range(12)], "query long, id long, cosine double, v array<double>, order int")
    for balance in (1.0, 0.5, 0.0):
        chosen = []
        while len(chosen) < 4:
            value = lambda i: balance * rel[i] - (1 - balance) * max([0.0, *(float(unit(v[i]) @ unit(v[j])) for j in chosen)])  # noqa: B023, E731
            chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: (round(value(i), 9), -i)))
        got = [r["id"] for r in vectors.rerank(rows, 4, balance).orderBy("place").collect()]
        assert got == chosen


def test_chunks_cover_sentences(spark):
    text = 'Dr. Smith met Mr. Jones. "Well," he said! It was late... ' + " ".join(f"Sentence number {i} is here." for i in range(40))
    spans = chunks.split(text)
    assert text[slice(*spans[0])] == "Dr. Smith met Mr. Jones." and all(not text[a].isspace() for a, _ in spans)
    packed = chunks.pack(spans, 200, 60)
    assert packed[0][0] == 0 and packed[-1][1] == len(text) and all(b - a <= 200 for a, b in packed)
    assert all(n[0] <= p[1] + 1 and n[1] > p[1] and p[1] - n[0] <= 60 for p, n in zip(packed, packed[1:], strict=False))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "x.")], "doc_id long, text string")
    out = chunks.chunked(docs, 200, 60).collect()
    leaves = sorted((r["place"], r["start"], r["end"]) for r in out if r["level"] == 0)
    assert [(a, b) for _, a, b in leaves] == packed
    assert {r["parent"] for r in out if r["level"] == 0} == {r["place"] for r in out if r["level"] == 1}


def test_datalog(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "a long, b long")
    out = datalog.run("path(X, Y) :- edge(X, Y).\npath(X, Z) :- path(X, Y), path(Y, Z).\nloop(X) :- path(X, X), X > 1.", {"edge": edge}, "loop")
    assert sorted(r["c0"] for r in out.collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        datalog.run("a(X) :- edge(X, _).", {"edge": edge}, "b")


def test_triangles_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)]
    got = {tuple(r) for r in graph.triangles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(0, i, i + 1) for i in range(1, 59)}


def test_two_stage_in_pieces_equals_the_plain_shortlist(spark, monkeypatch):
    """Many rows at the last distance, dealt over pieces: those of the least ids are shortlisted; no row of a shortlist is shuffled."""
    import numpy as np

    monkeypatch.setattr(vectors, "PIECE", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 6))
    v[250:] = v[:50]
    rows = spark.createDataFrame([(int(i), [float(x) for x in v[i]]) for i in range(300)], "vec_id long, embedding array<float>")
    f, first, want = v.astype(np.float32).astype(np.float64), 120, set()
    for q in range(0, 300, 50):
        h = ((f >= 0) != (f[q] >= 0)).sum(axis=1)
        short = [i for i in np.lexsort((np.arange(300), h)) if i != q][:first]
        c = f[short] @ f[q] / np.linalg.norm(f[short], axis=1) / np.linalg.norm(f[q])
        want |= {(q, int(short[p]), int(h[short[p]]), n + 1) for n, p in enumerate(np.lexsort((short, -np.round(c, 9)))[:5])}
    found = geometry.two_stage(rows, rows.filter("vec_id % 50 = 0"), 5, share=0.4)
    assert {(x["query"], x["id"], x["hamming"], x["rank"]) for x in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
