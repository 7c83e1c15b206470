"""Q-gram and term retrieval as joins on exploded postings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch

K1, B = 1.2, 0.75


def parse_query(text: str) -> list[str]:
    """Lower-case clauses: quoted phrases and single terms; an unclosed quote is a term."""
    return [(a or b).lower().strip('"') for a, b in re.findall(r'"([^"]+)"|(\S+)', text)]


def terms_of(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def grams(text: Column, q: int = 3) -> Column:
    """Distinct q-grams of the lower-cased text."""
    t = F.lower(text)
    return F.when(F.length(t) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda i: t.substr(i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, doc_len)."""
    t = docs.select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("terms"))
    return t.select("id", F.size("terms").alias("doc_len"), F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull()).groupBy("id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matched): documents by summed saturated tf times idf; statistics over all documents.
    Texts are read once: a row of counts per document is written and both passes read that."""
    scratch = Scratch(docs.sparkSession, "bm25")
    words = docs.select(F.col(id_col).alias("id"), terms_of(F.col(text_col)).alias("w"))
    tf = scratch.table(words.select("id", F.size("w").alias("doc_len"), F.filter("w", lambda x: x.isin(terms)).alias("w")).select(
        "id", "doc_len", *[F.size(F.filter("w", lambda x, t=t: x == t)).alias(f"tf{i}") if False else _times(t).alias(f"tf{i}") for i, t in enumerate(terms)]), "counts")
    row = tf.agg(F.count(F.lit(1)), F.avg("doc_len"), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(terms))]).first()
    n, avg = float(row[0]), float(row[1] or 1.0)
    norm = 1 - B + B * F.col("doc_len") / avg
    score, matched = F.lit(0.0), F.lit(0).cast("long")
    for i in range(len(terms)):
        t = F.col(f"tf{i}")
        score = score + F.when(t > 0, idf(F.lit(n), F.lit(row[2 + i])) * (K1 + 1) * t / (t + K1 * norm)).otherwise(0.0)
        matched = matched + (t > 0).cast("long")
    return tf.select(F.col("id").alias(id_col), score.alias("score"), matched.alias("matched")).filter("matched > 0")


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def containing(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, occurrences, first): exact substring search in one scan of each text; occurrences may overlap."""
    from lodestone.functions.qgram import occurrences

    m = docs.filter(F.lower(F.col(text_col)).contains(pattern.lower())).select(id_col, occurrences(F.lower(F.col(text_col)), pattern.lower()).alias("m"))
    return m.select(id_col, F.col("m.tf").alias("occurrences"), F.col("m.first").alias("first"))
