"""The stored q-gram index against the scan of all texts."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.functions import qgram
from lodestone.operators import inverted

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path_factory.mktemp("index") / "q")
    inverted.build(docs, path, files=2)
    return docs, inverted.load(spark, path)


@pytest.mark.parametrize("query", ['license "version 2.0" apache', "the", "an", "e", "aa", '"of the" tion', "zzzz", "é en", "ererer"])
def test_hits_equal_the_scan(spark, index, query):
    docs, stored = index
    want = {(r.doc_id, round(r.score, 6), r.matched) for r in qgram.search(docs, query).collect()}
    assert {(r.id, round(r.score, 6), r.matched) for r in inverted.search(spark, stored, query).collect()} == want


@pytest.mark.parametrize("query", ["the license", "tion", 'apache "of the"'])
def test_early_end_gives_the_same_best_and_skips_blocks(spark, index, query):
    docs, stored = index
    best, reading = inverted.Search(spark, stored, query).best(5)
    want = sorted(((round(r.score, 6), r.doc_id) for r in qgram.search(docs, query).collect()), key=lambda x: (-x[0], x[1]))[:5]
    assert [(r.score, r.id) for r in best.collect()] == want
    assert reading.first + reading.second <= reading.candidates and reading.skipped >= 0
    if query == "the license":
        assert reading.skipped > 0


def test_a_rare_query_reads_few_bytes(spark, tmp_path, monkeypatch):
    """Row groups that can hold its grams, against the bytes of the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(inverted, "ROW_GROUP", 1 << 14)
    stored = inverted.build(docs, str(tmp_path / "q"))
    grams = qgram.grams_of("apache")
    read = 0
    for f in os.listdir(f"{stored.path}/postings"):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(f"{stored.path}/postings/{f}").metadata
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(0).statistics
                if any(s.min <= x <= s.max for x in grams):
                    read += meta.row_group(g).total_byte_size
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert read < text / 10, (read, text)


def test_null_empty_and_overlapping_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, "AAAA"), (2, None), (3, ""), (None, "aaa"), (4, "aa"), (5, "x" * 5000 + "aaa😀aa")], "doc_id long, text string")
    stored = inverted.build(docs, str(tmp_path / "q"))
    for query in ("aaa", "aa", "a", "😀", "a😀a x"):
        want = {(r.doc_id, round(r.score, 4), r.matched) for r in qgram.search(docs.filter("doc_id IS NOT NULL"), query).collect()}
        assert {(r.id, round(r.score, 4), r.matched) for r in inverted.search(spark, stored, query).collect()} == want
    empty = inverted.build(docs.limit(0), str(tmp_path / "e"))
    assert inverted.search(spark, empty, "aaa").count() == 0 and inverted.Search(spark, empty, "aaa").best(3)[0].count() == 0
    assert inverted.Search(spark, stored, "").best(3)[1].candidates == 0


def test_postings_are_packed(spark, tmp_path):
    """Two bytes and a half a character at most, in one segment for each task (4.3 bytes as lists, and as much shuffled)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stored = inverted.build(docs, str(tmp_path / "q"))
    files = [f for f in os.listdir(f"{stored.path}/postings") if f.endswith(".parquet")]
    chars = docs.selectExpr("sum(length(text))").first()[0]
    assert sum(os.path.getsize(f"{stored.path}/postings/{f}") for f in files) < 2.5 * chars
    assert len(files) <= docs.rdd.getNumPartitions()
    assert stored.postings(spark).agg({"occurrences": "sum"}).first()[0] == chars


def test_packed_rows_come_back(spark, tmp_path):
    values = np.array([0, 127, 128, 16383, 16384, 1 << 21, (1 << 31) - 1])
    data, first = inverted._to_bytes(values)
    back, starts = inverted._from_bytes(data)
    assert back.tolist() == values.tolist() and starts.tolist() == first.tolist()
    wide = "".join(map(chr, range(0x4E00, 0x9FA5)))  # letters too many for one number of gram and place are sorted in another way
    docs = spark.createDataFrame([(7, "aaaa"), (7, "aaaa"), (8, wide * 60 + "aaaa"), (9, "baaa")], "doc_id long, text string").coalesce(1)
    stored = inverted.build(docs, str(tmp_path / "w"))
    for query in ("aaaa", "a", "baa aaa", wide[-1] + "aa"):  # repeated ids are rows of their own, as in the scan
        want = sorted((r.doc_id, round(r.score, 6), r.matched) for r in qgram.search(docs, query).collect())
        assert sorted((r.id, round(r.score, 6), r.matched) for r in inverted.search(spark, stored, query).collect()) == want
