"""Substring search scored by coverage and proximity: clauses, candidates, verification, scores.

A query is a list of clauses (terms and quoted phrases), each matched as a substring
of the lower-cased text.  Statistics take one pass over the documents, scores a
second one; neither shuffles rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.lexical import parse_query

# Saturation, length share, coverage exponent and floor, proximity weight and decay, segments of a text.
K1, B, LAMBDA, EPSILON, ALPHA, DECAY, SEGMENTS = 1.2, 0.75, 3.0, 0.1, 0.5, 0.1, 32
Q = 3


def occurrences(text: Column, pattern: str, segments: int = SEGMENTS) -> Column:
    """struct(tf, first, mask) of the places of a pattern in a text, overlapping ones too; mask has a bit for
    each of the equal parts of the text in which a place lies.  One scan, whatever the number of places."""
    quoted = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(text, f"(?={quoted})", -1)
    size = F.greatest(F.length(text), F.lit(1))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("tf"), F.lit(-1).alias("first"), F.lit(0).cast("bigint").alias("mask"), F.startswith(text, F.lit(pattern)).alias("hit")
    )

    def step(a: Column, part: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.lit(segments - 1), F.floor(a["at"] * segments / size).cast("int")))
        return F.struct(
            (a["at"] + F.length(part)).alias("at"), (a["tf"] + a["hit"].cast("int")).alias("tf"), F.when(a["hit"] & (a["first"] < 0), a["at"]).otherwise(a["first"]).alias("first"),
            F.when(a["hit"], a["mask"].bitwiseOR(bit)).otherwise(a["mask"]).alias("mask"), F.lit(True).alias("hit"),
        )

    return F.aggregate(parts, start, step, lambda a: F.struct(a["tf"].alias("tf"), a["first"].alias("first"), a["mask"].alias("mask")))


def grams_of(pattern: str, q: int = Q) -> list[str]:
    """The q-grams of a clause; a shorter clause is its own gram."""
    return sorted({pattern[i : i + q] for i in range(len(pattern) - q + 1)}) or [pattern]


def corpus(docs: DataFrame, clauses: list[str], text_col: str = "text") -> tuple[int, float, dict[str, int]]:
    """(documents, mean length, documents with each gram of the clauses): one row."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    grams = sorted({g for c in clauses for g in grams_of(c)})
    row = docs.agg(F.count(F.lit(1)), F.avg(F.length(t)), *[F.count_if(t.contains(g)) for g in grams]).first()
    return row[0], float(row[1] or 0.0), dict(zip(grams, row[2:], strict=True))


def idf(n: float, df: float) -> float:
    import math

    return math.log(1 + max(0.0, (n - df + 0.5) / (df + 0.5))) if df else 0.0


def rarest(clause: str, df: dict[str, int]) -> str:
    """The gram of a clause that the fewest documents hold: the gate of that clause."""
    return min(grams_of(clause), key=lambda g: (df[g], g))


def candidates(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clauses): documents that hold all grams of a clause, and how many clauses that is true of."""
    t = F.lower(F.col(text_col))
    held = [reduce(lambda a, b: a & b, [t.contains(g) for g in grams_of(c)]).cast("int") for c in parse_query(query)]
    return docs.select(id_col, F.coalesce(reduce(lambda a, b: a + b, held), F.lit(0)).alias("clauses")).filter("clauses > 0")


def matched(docs: DataFrame, clauses: list[str], df: dict[str, int], keep: list[str] = [], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B006
    """(id, size, m): documents behind the gate of a clause, with the verified occurrences of every clause."""
    t = F.lower(F.col(text_col))
    gate = reduce(lambda a, b: a | b, [t.contains(rarest(c, df)) for c in clauses])
    return docs.filter(gate).select(id_col, *keep, F.length(t).alias("size"), *[occurrences(t, c).alias(f"m{i}") for i, c in enumerate(clauses)])


def search(
    docs: DataFrame, query: str, variant: str = "plain", id_col: str = "doc_id", text_col: str = "text", keep: list[str] = [],  # noqa: B006
) -> DataFrame:
    """(id, score, matched) of documents that hold a clause; quoted phrases must occur.

    variant: ``plain``; ``constant``, whose proximity does not decay with length and whose idf is that of
    the rarest gram; ``double``, which saturates twice."""
    clauses = parse_query(query)
    phrases = {c for c in clauses if " " in c}
    n, mean, df = corpus(docs, clauses, text_col)
    m = matched(docs, clauses, df, keep, id_col, text_col)
    share = F.col("size") / F.lit(mean or 1.0)
    base, count = F.lit(0.0), F.lit(0)
    common, bits = F.lit(-1).cast("bigint"), F.lit(SEGMENTS)
    for i, c in enumerate(clauses):
        tf = F.col(f"m{i}.tf")
        weight = max(idf(n, df[g]) for g in grams_of(c))
        if variant == "double":
            x = 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * share))
            sat = x / (1 + x / 1.2)
        else:
            x = tf / (1 - B + B * share)
            sat = (K1 + 1) * x / (K1 + x)
        base = base + F.when(tf > 0, weight * sat).otherwise(0.0)
        count = count + (tf > 0).cast("int")
        common = common.bitwiseAND(F.when(tf > 0, F.col(f"m{i}.mask")).otherwise(F.lit(-1).cast("bigint")))
    decay = F.exp(-DECAY * (F.lit(1.0) if variant == "constant" else share))
    near = F.when(F.col("matched") > 1, 1 + ALPHA * F.bit_count(common) / F.least(F.col("matched"), bits) * decay).otherwise(1.0)
    m = m.withColumn("matched", count)
    for i, c in enumerate(clauses):
        if c in phrases:
            m = m.filter(F.col(f"m{i}.tf") > 0)
    score = base * F.pow(EPSILON + F.col("matched") / F.lit(float(len(clauses))), F.lit(LAMBDA)) * near
    return m.filter("matched > 0").select(id_col, *keep, score.alias("score"), "matched")


def segments_of(length: Column, tokens: int = 50) -> Column:
    """The number of segments of a text of so many tokens: 8 to 32."""
    return F.greatest(F.lit(8), F.least(F.lit(32), F.ceil(length / tokens).cast("int")))


def remap(mask: Column, have: int, want: Column) -> Column:
    """A mask of ``have`` segments as one of ``want`` segments: bit i goes to i * want / have."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(have - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    return F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(i * want / have).cast("int")))
    )


# Suffixes in the order in which they are tried, and the consonants of which a double one is cut.
SUFFIXES = "ingly edly ment ness tion sion able ible less ously ing ers ies ied est ism ist ous ive ful ly ed es er s".split()
_DOUBLES = "bcdfghjklmnpqrstvwxyz"


def stem(word: Column) -> Column:
    """A word's root: the first suffix that leaves three letters is cut, a final i is y, a double consonant single."""
    w = F.regexp_replace(F.lower(word), "[^a-z'-]", "")
    cut = w
    for s in reversed(SUFFIXES):
        cut = F.when(w.endswith(s) & (F.length(w) - len(s) >= 3), w.substr(F.lit(1), F.length(w) - len(s))).otherwise(cut)
    y = F.when(cut.endswith("i") & (F.length(cut) > 3), F.concat(cut.substr(F.lit(1), F.length(cut) - 1), F.lit("y"))).otherwise(cut)
    twice = y.rlike(f"([{_DOUBLES}])\\1$") & (F.length(y) >= 3)
    return F.when(F.length(w) <= 4, w).otherwise(F.when(twice, y.substr(F.lit(1), F.length(y) - 1)).otherwise(y))
