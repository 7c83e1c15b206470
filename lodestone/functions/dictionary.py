"""A stored dictionary of terms with values: exact, prefix, range and fuzzy lookups, and merges.

Terms are written once, sorted and in small row groups, so that exact, prefix and range lookups
read only the groups that can hold them.  A fuzzy lookup is an equi-join: two terms within k edits
share a string that both become by deleting at most k characters from their first ``PREFIX`` ones
(what an alignment leaves unmatched or shifts past the prefix is at most k on either side), so terms and
queries meet on those strings, and the edit distance of those that met is verified.

Defined results: null terms are left out; equal terms are one, with their values merged; queries may
repeat; an empty dictionary finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 12
ROW_GROUP = 1 << 20
_MERGES = {"min": F.min, "max": F.max, "sum": F.sum}


def merged(*tables: DataFrame, how: str = "sum") -> DataFrame:
    """(term, value) of several tables, the values of a term by ``min``, ``max`` or ``sum``."""
    if how not in _MERGES:
        raise ValueError(f"how must be one of {sorted(_MERGES)}")
    all_ = reduce(DataFrame.unionByName, (t.select("term", "value") for t in tables))
    return all_.filter("term IS NOT NULL").groupBy("term").agg(_MERGES[how]("value").alias("value"))


def build(terms: DataFrame, path: str, how: str = "sum") -> None:
    """Write a dictionary of terms (term, value) below path."""
    merged(terms, how=how).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def exact(spark, path: str, term: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("term") == term)


def prefix(spark, path: str, start: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("term").startswith(start))


def between(spark, path: str, low: str, high: str) -> DataFrame:
    """Terms from low on, before high."""
    return spark.read.parquet(path).filter((F.col("term") >= low) & (F.col("term") < high))


def ends(spark, path: str) -> DataFrame:
    """(least, greatest) term."""
    return spark.read.parquet(path).agg(F.min("term").alias("least"), F.max("term").alias("greatest"))


def _shorter(word: Column) -> Column:
    """The strings with one character less."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(word: Column, k: int) -> Column:
    """What the first PREFIX characters of a word become by deleting at most k of them."""
    all_ = last = F.array(F.substring(word, 1, PREFIX))
    for _ in range(k):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, _shorter(w)).otherwise(F.array().cast("array<string>")))))
        all_ = F.array_union(all_, last)
    return all_


def fuzzy(terms: DataFrame, queries: DataFrame, k: int = 2) -> DataFrame:
    """(query, term, value, distance) of all terms within k edits of a query (column query)."""
    asked = queries.select("query").dropna().distinct()
    met = asked.select("query", F.explode(deletions(F.col("query"), k)).alias("d")).join(terms.select("term", F.explode(deletions(F.col("term"), k)).alias("d")), "d")
    # lengths first: they are cheap, and pairs may meet on several strings
    near = met.filter(F.abs(F.length("query") - F.length("term")) <= k).select("query", "term").distinct()
    near = near.withColumn("distance", F.levenshtein("query", "term", k)).filter("distance >= 0")
    return near.join(terms.select("term", "value"), "term").select("query", "term", "value", "distance")
