"""Queries of segments, resolution, timelines and set algebra against their SQL twins."""

import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from lodestone.operators import resolution
from lodestone.plans import catalogue, textual

WHERE = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == textual.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{WHERE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = catalogue.QUERIES[name](spark, WHERE)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert len(rows) == len(want)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_rows_of_equal_traits_are_scored_once(spark):
    """30,000 rows of one block: 900 million pairs of rows, 9 of profiles."""
    rows = spark.range(30_000).select("id", F.lit("b").alias("block"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("kind"))
    score = lambda a, b: F.when(F.col(a + "kind") == F.col(b + "kind"), 2).otherwise(1)
    got = resolution.best_candidates(rows, ["block"], ["kind"], score, 2)
    assert got.count() == 60_000
    some = {tuple(r) for r in got.filter("mention IN (0, 1, 7, 29999)").collect()}
    assert some == {(0, 1, 1, 1), (0, 2, 1, 2), (1, 4, 2, 1), (1, 7, 2, 2), (7, 1, 2, 1), (7, 4, 2, 2), (29999, 2, 2, 1), (29999, 5, 2, 2)}
