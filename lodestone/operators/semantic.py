"""Candidate edges between nodes of like meaning, from stored vector indexes, and contradictions among them.

Each family of nodes (claims, events, states, ...) has an index of its own; every node asks it for its
nearest ones.  An edge needs both ends to name each other (a mutual pair), planes that go together, and
a similarity of at least ``LEAST``; it is given once, the lesser node first.  An edge between nodes of
opposite polarity is a candidate contradiction.

Defined results: nodes without a family, vector or id take no part; null planes go with every plane, null
polarities contradict nothing; copies of a vector are neighbours like any other; an empty table has no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import vector_index

LEAST, NEAREST, MOST_FAMILIES = 0.6, 10, 1000


def candidate_edges(nodes: DataFrame, path: str, k: int = NEAREST, least: float = LEAST, probes: int | None = None) -> DataFrame:
    """(a, b, family, cosine, kind) for nodes (id, family, plane, polarity, v), with the indexes below path; kind is
    ``supports`` or ``contradicts``.  probes: cells that a node asks; chosen by recall for each index if not given."""
    spark = nodes.sparkSession
    families = sorted(r[0] for r in nodes.select(F.col("family").cast("string").alias("f")).dropna().distinct().limit(MOST_FAMILIES + 1).collect())
    if len(families) > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} families: an index for each is too many")
    found = spark.createDataFrame([], "a long, b long, cosine double")
    for n, family in enumerate(families):
        own = nodes.filter(F.col("family").cast("string") == family)
        index = vector_index.build(own, f"{path}/{n}", id_col="id", vec_col="v")
        if probes is None:
            index = vector_index.tune(index, spark, k)
        hits = vector_index.search(index, own, k, probes, id_col="id", vec_col="v")
        found = found.unionByName(hits.select(F.col("query").alias("a"), F.col("id").alias("b"), "cosine"))
    # a mutual pair is found from both ends
    pair = found.filter(F.round("cosine", 9) >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    mutual = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).filter("n = 2")
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("family").cast("string").alias("family"), F.col("plane").alias(f"plane_{s}"), F.col("polarity").alias(f"polarity_{s}"))
    both = mutual.join(side("a"), "a").join(side("b"), ["b", "family"])
    fit = F.col("plane_a").isNull() | F.col("plane_b").isNull() | (F.col("plane_a") == F.col("plane_b"))
    kind = F.when(F.col("polarity_a") != F.col("polarity_b"), "contradicts").otherwise("supports")
    return both.filter(fit).select("a", "b", "family", "cosine", kind.alias("kind"))
