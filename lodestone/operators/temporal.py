"""Edges with a validity (closed at both ends; a null start and end is timeless) and bi-temporal batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timeless() -> Column:
    return F.col("valid_from").isNull() & F.col("valid_until").isNull()


def edges_during(edges: DataFrame, start: Column, end: Column, mode: str = "snapshot", relations: list[str] | None = None) -> DataFrame:
    """Edges valid at some time of [start, end].  mode: ``strict`` leaves timeless edges out, ``snapshot`` keeps
    them, ``full`` keeps every edge.  relations: an allow-list of the column rel."""
    if relations is not None:
        edges = edges.filter(F.col("rel").isin(relations))
    if mode == "full":
        return edges
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= start))
    if mode == "strict":
        return edges.filter(valid & ~_timeless())
    if mode != "snapshot":
        raise ValueError(f"no such mode: {mode}")
    return edges.filter(valid)


def edges_as_of(edges: DataFrame, at: Column, mode: str = "snapshot", relations: list[str] | None = None) -> DataFrame:
    return edges_during(edges, at, at, mode, relations)


def apply_batch(old: DataFrame, new: DataFrame, scope: Column, at: Column) -> DataFrame:
    """old with the open rows of a scope expired at a time, and new appended as recorded then.
    Both have recorded_at and expired_at."""
    closed = old.withColumn("expired_at", F.when(scope & F.col("expired_at").isNull(), at).otherwise(F.col("expired_at")))
    return closed.unionByName(new.withColumns({"recorded_at": at, "expired_at": F.lit(None).cast("timestamp")}), allowMissingColumns=True)


def prune(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "node") -> DataFrame:
    """Edges whose both ends are live nodes."""
    return edges.join(nodes.select(F.col(key).alias(src)), src, "left_semi").join(nodes.select(F.col(key).alias(dst)), dst, "left_semi")
