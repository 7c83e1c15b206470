"""Cutting texts: sentences with abbreviations, packed chunks with overlap and parents, chapters, known surfaces."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import ROWS, Scratch, pieces

# Abbreviations after which a full stop ends no sentence, and words that open a chapter.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e fig no vol".split())
CHAPTER_WORDS = ("chapter", "part", "book", "prologue", "epilogue", "section")
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|\Z)")


def split(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without the blanks around them."""
    text = text or ""
    out, start = [], 0
    for m in _END.finditer(text):
        word = text[start : m.start()].rsplit(None, 1)[-1:] or [""]
        if m[0][0] == "." and word[0].lower().rstrip(".") in ABBREVIATIONS:
            continue
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        b -= len(part) - len(part.rstrip())
        if b > a:
            trimmed.append((a, b))
    return trimmed


def pack(spans: list[tuple[int, int]], most: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of sentences of at most ``most`` characters (a longer sentence is a chunk of its own); each run starts
    with the last sentences of the one before that fit in ``overlap`` characters."""
    out, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][1] - spans[i][0] <= most:
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j >= len(spans):
            break
        k = j
        while k - 1 > i and spans[j - 1][1] - spans[k - 1][0] <= overlap and spans[j][1] - spans[k - 1][0] <= most:
            k -= 1
        i = k
    return out


def chunked(docs: DataFrame, most: int = 400, overlap: int = 80, family: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, level, place, start, end, parent): leaf chunks (level 0) and their parents (level 1), ``family`` leaves each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["text"], strict=True):
                leaves = pack(split(t), most, overlap)
                rows += [(i, 0, k, a, b, k // family) for k, (a, b) in enumerate(leaves)]
                for p in range(0, len(leaves), family):
                    rows.append((i, 1, p // family, leaves[p][0], leaves[min(p + family, len(leaves)) - 1][1], -1))
            yield pd.DataFrame(rows, columns=["id", "level", "place", "start", "end", "parent"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    return plain.mapInPandas(run, "id long, level int, place int, start int, end int, parent int").withColumnRenamed("id", id_col)


_WORD = re.compile(r"\w+")
# Fixed value: the similarity of neighbours below which the topic has changed.
TOPIC_SHIFT = 0.6


def word_counts(text: str, cells: int = 64) -> dict[int, int]:
    """A vector of a text, by its places that are not 0: its words, in lower case, counted in cells of their hashes."""
    return Counter(zlib.crc32(w.encode()) % cells for w in _WORD.findall(text.lower()))


def _alike(a: dict[int, float], b: dict[int, float]) -> float:
    m = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b.get(k, 0) for k, x in a.items()) / m if m else 0.0


def units(text: str | None, most: int) -> list[tuple[int, int, bool]]:
    """(start, end, structural): the lines of a text; of a line longer than most its sentences, the last of which is structural as lines are."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        a, b = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        at += len(line) + 1
        if b - a > most:
            inner = split(line)
            out += [(at - len(line) - 1 + x, at - len(line) - 1 + y, k == len(inner) - 1) for k, (x, y) in enumerate(inner)]
        elif b > a:
            out.append((a, b, True))
    return out


def semantic(text: str | None, least: int, most: int, shift: float = TOPIC_SHIFT, vector: Callable[[str], dict] = word_counts) -> list[tuple[int, int, int]]:
    """(start, end, units) of chunks: a unit opens a new one if the chunk would be longer than most, or if it has least
    characters and the unit is structural or unlike the one before it."""
    parts = units(text, most)
    vs = [vector(text[a:b]) for a, b, _ in parts]
    out, first, size = [], 0, 0
    for i, (a, b, structural) in enumerate(parts):
        if i > first and (size + b - a > most or (size >= least and (structural or _alike(vs[i - 1], vs[i]) < shift))):
            out.append((parts[first][0], parts[i - 1][1], i - first))
            first, size = i, 0
        size += b - a
    if parts:
        out.append((parts[first][0], parts[-1][1], len(parts) - first))
    return out


def semantic_chunked(docs: DataFrame, least: int = 200, most: int = 800, shift: float = TOPIC_SHIFT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, start, end, units): the semantic chunks of every document, in code points; null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, *c) for i, t in zip(f["id"], f["text"], strict=True) for k, c in enumerate(semantic(t, least, most, shift))]
            yield pd.DataFrame(rows, columns=["id", "place", "start", "end", "units"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return plain.mapInPandas(run, "id long, place int, start int, end int, units int").withColumnRenamed("id", id_col)


def chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, title, until): lines that open a chapter (a chapter word, or a number such as 2.1) and the line before
    which it ends."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "title"))
    opens = F.lower("title").rlike(f"^({'|'.join(CHAPTER_WORDS)}) ") | F.col("title").rlike(r"^[0-9]+(\.[0-9]+)*\.? ")
    w = Window.partitionBy(id_col).orderBy("line")
    return lines.filter(opens).withColumn("until", F.lead("line").over(w)).select(id_col, "line", "title", "until")


#: Surfaces of a lexicon that is sent to all executors.
SMALL = 1 << 17
#: Texts of a task are some quarter of the rows of other tasks: two tables of (id, entity) are held for them.
HELD = 4


def surfaces(docs: DataFrame, lexicon: DataFrame, longest: int, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, entity, n): how often known surfaces stand in a text.  lexicon: surface (tokens joined by a space), entity.
    Texts are dealt by id, as many to a task whatever the input, and counted where they are.  Every run of up to ``longest``
    tokens is looked up by an equi-join: a lexicon of more than ``SMALL`` rows, which may be of any size, is dealt by surface,
    but for surfaces that stand in more places than a task has rows."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "surfaces")
    t = docs.repartition(pieces(spark, HELD * docs.count()), id_col).select(id_col, tokens.alias("t"))
    none = F.array().cast("array<string>")
    grams = [F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - (n - 1))), _gram(n))).otherwise(none) for n in range(1, longest + 1)]
    parts = t.select(id_col, F.explode(F.concat(*grams)).alias("surface"))
    known = scratch.table(lexicon.select("surface", "entity"), "lexicon")
    if known.count() <= SMALL:
        found = parts.join(F.broadcast(known), "surface")
    else:
        places = scratch.table(parts.groupBy("surface").agg(F.count(F.lit(1)).alias("places")), "places")
        hot = F.broadcast(places.filter(F.col("places") > ROWS).select("surface"))
        rest = parts.join(hot, "surface", "left_anti").repartition(pieces(spark, places.agg(F.sum("places")).first()[0]), "surface")
        found = parts.join(F.broadcast(known.join(hot, "surface", "left_semi")), "surface").union(rest.join(known, "surface").select("surface", id_col, "entity"))
    return found.groupBy(id_col, "entity").agg(F.count(F.lit(1)).alias("n"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("t", i, n), " ")
