"""Text segments as DataFrame expressions: sentences, tokens, echoes, cadence, syntax marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, sentence): parts between runs of ``.!?`` that hold more than blanks; at counts all parts from 0."""
    parts = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "[.!?]+", -1)).alias("at", "sentence"))
    return parts.withColumn("sentence", F.trim("sentence")).filter(F.col("sentence") != "")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, word): lower-case runs of ASCII letters in order."""
    return docs.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("([a-z]+)"), F.lit(1))).alias("at", "word"))


def echoes(words: DataFrame, within: int = 26, least: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, word, n_echoes, nearest): repeats of a word of at least ``least`` letters at most ``within`` tokens after its last use."""
    again = Window.partitionBy(id_col, "word").orderBy("at")
    gap = words.filter(F.length("word") >= least).withColumn("gap", F.col("at") - F.lag("at").over(again))
    return gap.filter(F.col("gap") <= within).groupBy(id_col, "word").agg(F.count("*").alias("n_echoes"), F.min("gap").cast("long").alias("nearest"))


def repeated_ngrams(words: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """(id, gram, n_found): sequences of n tokens that a text holds twice or more."""
    order = Window.partitionBy(id_col).orderBy("at")
    gram = F.concat_ws(" ", "word", *[F.lead("word", k).over(order) for k in range(1, n)])
    whole = F.lead("word", n - 1).over(order).isNotNull()
    return words.select(id_col, F.when(whole, gram).alias("gram")).filter("gram IS NOT NULL").groupBy(id_col, "gram").agg(F.count("*").alias("n_found")).filter("n_found >= 2")


def cadence(parts: DataFrame, reach: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(id, at, n_chars, around): each sentence's length and the mean length of the sentences up to ``reach`` before and after."""
    near = Window.partitionBy(id_col).orderBy("at").rowsBetween(-reach, reach)
    sized = parts.select(id_col, F.col("at").cast("long").alias("at"), F.length("sentence").cast("long").alias("n_chars"))
    return sized.withColumn("around", F.avg("n_chars").over(near))


def marks(text: Column) -> list[Column]:
    """Numbers of wikilinks, tags and mentions in a text."""
    count = lambda p: F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))), F.lit(0)).cast("long")
    return [count(r"\[\[[^\]]+\]\]").alias("n_links"), count("#[A-Za-z0-9_]+").alias("n_tags"), count("@[A-Za-z0-9_]+").alias("n_mentions")]
