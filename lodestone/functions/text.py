"""Document statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch

WORDS_PER_MINUTE = 225


def statistics(text: Column) -> dict[str, Column]:
    """words, characters, non_space, sentences, paragraphs, reading_minutes."""
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    return {
        "words": words,
        "characters": F.coalesce(F.length(text), F.lit(0)),
        "non_space": F.coalesce(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(0)),
        "sentences": F.coalesce(F.regexp_count(text, F.lit(r"[^.!?]*[^.!?\s][^.!?]*")), F.lit(0)),
        "paragraphs": F.coalesce(F.regexp_count(text, F.lit(r"[^\n]+")), F.lit(0)),
        "reading_minutes": F.ceil(words / WORDS_PER_MINUTE),
    }


def keyword_density(docs: DataFrame, terms: Column, top: int) -> DataFrame:
    """(term, n, percent): words of four letters and more over all documents."""
    scratch = Scratch(docs.sparkSession, "keywords")
    t = docs.select(F.explode_outer(terms).alias("term")).filter(F.length("term") >= 4)
    counts = scratch.table(t.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")  # the texts are read once
    n = counts.agg(F.sum("n")).first()[0] or 1
    return counts.orderBy(F.desc("n"), "term").limit(top).withColumn("percent", F.round(100.0 * F.col("n") / F.lit(n), 4))
