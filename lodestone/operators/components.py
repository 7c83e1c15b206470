"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one join on edges; each round's edges are a
written table, so no lineage builds up and a lost executor costs one round.
The rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every end of an edge; a component is named by its least node.
    edges: columns u and v of one comparable type; loops and repeated edges do not matter."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    size = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    loops = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = scratch.table(_clean(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    was = size(now)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        new = scratch.table(_clean(_small_star(_clean(_large_star(now)))), "edges")
        is_now = size(new)
        scratch.drop(now)
        now = new
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError("components did not settle")
    return loops.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
