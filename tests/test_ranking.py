"""Fusion, ranked states, snapshots, journals and streams on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.operators import ranking
from lodestone.sources import snapshots
from lodestone.streaming import mentions


def test_truth_plane_and_abstaining(spark):
    rows = [(["asserted", "observed"],), (["planned"],), (["planned", "inferred"],), ([],)]
    planes = spark.createDataFrame(rows, "m array<string>").select(ranking.truth_plane(F.col("m")).alias("p")).collect()
    assert [r["p"] for r in planes] == ["world", "planned", "mixed", "unknown"]
    a = spark.createDataFrame([(1.7, 0), (2.0, 1), (2.0, 0)], "s double, n int").select(ranking.abstains(F.col("s"), F.lit(True), F.col("n")).alias("x"))
    assert [r["x"] for r in a.collect()] == [True, True, False]


def test_evaluate(spark):
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, rank int")
    gold = spark.createDataFrame([("q", "b", 1), ("q", "c", 1)], "query string, item string, grade int")
    r = ranking.evaluate(res, gold).first()
    assert (r["precision"], r["recall"], r["f1"], r["reciprocal_rank"]) == (0.5, 0.5, 0.5, 0.5)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_mobius_identity(spark):
    v = spark.createDataFrame([([0.1, 0.2], [0.0, 0.0])], "a array<double>, b array<double>")
    assert v.select(geometry.mobius_add("a", "b").alias("s")).first()["s"] == pytest.approx([0.1, 0.2])


def test_snapshot_round_trip(spark, tmp_path):
    t = {"a": spark.range(3), "b": spark.range(2).withColumn("x", F.lit("y"))}
    snapshots.export_snapshot(spark, t, str(tmp_path / "s"), {"content": ["b"]}, "content")
    back = snapshots.import_snapshot(spark, str(tmp_path / "s"))
    assert list(back) == ["b"] and sorted(map(tuple, back["b"].collect())) == [(0, "y"), (1, "y")]


def test_replay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    journal = spark.createDataFrame([(1, "c", 1, False), (1, "d", 2, False), (2, "b", 3, True)], "k int, v string, seq long, deleted boolean")
    assert [tuple(r) for r in snapshots.replay(base, journal, ["k"]).collect()] == [(1, "d")]


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = mentions.window_counts(s, "t", "k").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [("x", 2), ("y", 1)]


def test_pairs_and_marks(spark):
    s = spark.createDataFrame([(1, ["b", "a", "c", "a"]), (2, ["z"])], "g int, e array<string>").withColumn("t", F.current_timestamp())
    assert sorted((r["a"], r["b"]) for r in mentions.pairs_in_window(s, "t", "g", "e").collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    m = spark.createDataFrame([("p", 1), ("p", 3), ("q", 1)], "thread string, at int")
    marks = spark.createDataFrame([("p", 2)], "thread string, mark int")
    assert sorted(map(tuple, mentions.unobserved(m, marks, "thread", "at").collect())) == [("p", 3), ("q", 1)]
