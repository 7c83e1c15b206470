"""Pronouns resolved by the mentions before them.

Mentions of a document are walked in order with a short history: the last ``HISTORY`` distinct
entities, the most recent first (a new mention of one moves it to the front).  A pronoun stands for
the first entity of the history whose gender goes with it.  Documents are dealt by id and sorted,
and a task walks its rows as a stream; it holds the history of one document.

Defined results: a pronoun with no match in the history is unresolved (null); entities
without a known gender go with every pronoun; null ids are documents of no one and stay unresolved;
mentions at one place are taken in the order of their entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY = 10
# Pronouns by gender (male, female, neutral, plural); U is an unknown gender.
PRONOUNS = {"M": "he him his", "F": "she her hers", "N": "it its", "P": "they them their"}


def gender_of(word: Column) -> Column:
    """The gender of a pronoun; null for another word."""
    out = F.lit(None).cast("string")
    for g, words in PRONOUNS.items():
        out = F.when(F.lower(word).isin(*words.split()), g).otherwise(out)
    return out


def agree(entity: str, pronoun: str) -> bool:
    """Whether an entity of a gender may be meant by a pronoun of a gender."""
    return entity == pronoun or "U" in (entity, pronoun) or (pronoun == "P" and entity == "N")


def mentions(docs: DataFrame, names: str = "^[A-Z][a-z]{3,}$", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, entity, pronoun): words that look like a name, and pronouns (their gender), with the number of the word."""
    w = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit("([A-Za-z]+)"), F.lit(1))).alias("place", "word"))
    p = gender_of(F.col("word"))
    return w.select("id", "place", F.when(p.isNull() & F.col("word").rlike(names), F.col("word")).alias("entity"), p.alias("pronoun")).filter("entity IS NOT NULL OR pronoun IS NOT NULL")


def resolve(found: DataFrame, registry: DataFrame, history: int = HISTORY) -> DataFrame:
    """(id, place, pronoun, entity) of the pronouns of found (id, place, entity, pronoun).  registry: entity, gender (M, F, N, P or U)."""
    known = registry.groupBy("entity").agg(F.min("gender").alias("gender"))
    rows = found.join(known, "entity", "left").select(F.col("id").cast("long").alias("id"), F.col("place").cast("int").alias("place"), "entity", F.coalesce("gender", F.lit("U")).alias("gender"), "pronoun")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, {}  # entity to gender, the most recent last
        for b in batches:
            out = []
            for i, place, entity, gender, pronoun in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != now or i is None:
                    now, recent = i, {}
                if pronoun is None:
                    recent.pop(entity, None)
                    recent[entity] = gender
                    if len(recent) > history:
                        del recent[next(iter(recent))]
                else:
                    out.append((i, place, pronoun, next((e for e in reversed(recent) if agree(recent[e], pronoun)), None)))
            ids, places, pronouns, entities = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(pronouns, pa.string()), pa.array(entities, pa.string())], names=["id", "place", "pronoun", "entity"])

    return rows.repartition("id").sortWithinPartitions("id", "place", "entity").mapInArrow(run, "id long, place int, pronoun string, entity string")
