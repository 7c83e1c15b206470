"""Fused and ranked results: lexical and vector blends, rank fusion, evaluation, ranked slot states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch

# The prior of a status, the penalty of a truth plane that is not the world, the weights of a blend.
STATUS_PRIOR = {"supported": 1.0, "active": 0.95, "candidate": 0.65, "deferred": 0.4, "contradicted": 0.15, "superseded": 0.05, "rejected": 0.0}
OTHER_STATUS = 0.2
SPECULATIVE = {"reported": 0.35, "conditional": 0.55, "planned": 0.65, "hypothetical": 0.75, "mixed": 0.45}
WORLD = ("asserted", "observed", "inferred")
VECTOR_SHARE, LEXICAL_TOP, RRF = 0.3, 10.0, 60


def _table(of: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def blend(lexical: Column, cosine: Column, share: float = VECTOR_SHARE) -> Column:
    """Weighted sum of a capped lexical score and a cosine brought to 0..1; a missing one counts as 0."""
    lex = F.least(F.coalesce(lexical, F.lit(0.0)), F.lit(LEXICAL_TOP)) / LEXICAL_TOP
    vec = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2)), F.lit(0.0))
    return lex * (1 - share) + vec * share


def reciprocal_rank(*ranked: DataFrame, key: str = "id") -> DataFrame:
    """(key, score) of several tables (key, rank from 0): the sum of 1 / (RRF + rank + 1)."""
    one = None
    for r in ranked:
        part = r.select(key, (F.lit(1.0) / (F.col("rank") + RRF + 1)).alias("s"))
        one = part if one is None else one.unionAll(part)
    return one.groupBy(key).agg(F.sum("s").alias("score"))


def merge_best(key: str, score: str, *results: DataFrame) -> DataFrame:
    """Union of result lists with the highest score of each key."""
    out = results[0].select(key, score)
    for r in results[1:]:
        out = out.unionAll(r.select(key, score))
    return out.groupBy(key).agg(F.max(score).alias(score))


def evaluate(results: DataFrame, gold: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """Precision, recall, F1, reciprocal rank and nDCG of results (query, item, rank from 1) against gold (query, item, grade > 0)."""
    order = Window.partitionBy(query).orderBy(F.desc("grade"), item)
    ideal = gold.withColumn("place", F.row_number().over(order))
    depth = results.groupBy(query).agg(F.max("rank").alias("depth"))
    best = ideal.join(depth, query, "left").groupBy(query).agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= F.col("depth"), F.col("grade") / F.log2(F.col("place") + 1))).alias("ideal"))
    hit = results.join(gold, [query, item], "left").groupBy(query).agg(
        F.count(F.lit(1)).alias("found"), F.count("grade").alias("hits"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("gain"),
    )
    both = hit.join(best, query)
    p, r = F.col("hits") / F.col("found"), F.col("hits") / F.col("relevant")
    return both.select(
        query, p.alias("precision"), r.alias("recall"), F.when(F.col("hits") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("gain") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
    )


def truth_plane(modalities: Column) -> Column:
    """The plane of a set of modalities: several planes are mixed, none is unknown."""
    planes = F.array_distinct(F.transform(modalities, lambda m: F.when(m.isin(*WORLD), F.lit("world")).otherwise(m)))
    return F.when(F.size(planes) == 0, "unknown").when(F.size(planes) > 1, "mixed").otherwise(F.get(planes, F.lit(0)))


def temporal_fitness(start: Column, end: Column) -> Column:
    return F.least(F.lit(1.0), F.when(end.isNull(), 1.0).otherwise(0.85) + F.when(start.isNotNull(), 0.05).otherwise(0.0))


def state_score(gate: Column, status: Column, confidence: Column, claims: Column, evidence: Column, start: Column, end: Column, conflicts: Column, gaps: Column, contradictions: Column, plane: Column) -> Column:
    """The score of a slot state: prior, support and fitness less what speaks against it."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))
    support = sure * 0.7 + F.least(claims, F.lit(4)) / 4 * 0.2 + F.least(evidence, F.lit(6)) / 6 * 0.1
    against = F.least(conflicts * 0.18, F.lit(0.45)) + F.least(gaps * 0.14, F.lit(0.45)) + F.least(contradictions * 0.12, F.lit(0.36))
    return gate + _table(status, STATUS_PRIOR, OTHER_STATUS) + support + temporal_fitness(start, end) - against - _table(plane, SPECULATIVE, 0.0)


def abstains(score: Column, gated: Column, issues: Column) -> Column:
    """Whether no answer should be given on the best state."""
    return ~gated | (score < 1.75) | ((issues > 0) & (score < 2.1))


def fielded(docs: DataFrame, terms: list[str], fields: dict[str, float], k1: float = 1.2, b: float = 0.75, alpha: float = 0.5, decay: float = 0.1, phrase: float = 1.5) -> DataFrame:
    """(id, score, matched): BM25 over weighted fields (arrays of tokens), times a proximity multiplier of the places
    that terms share and a boost where each term's first place follows the one before.  Statistics are one row."""
    lengths = [F.avg(F.size(f)) for f in fields]
    has = [sum((F.size(F.filter(f, _is(t))) for f in fields), F.lit(0)) > 0 for t in terms]
    row = docs.agg(F.count(F.lit(1)), *lengths, *[F.count_if(h) for h in has]).first()
    n, mean = row[0], dict(zip(fields, [float(x or 1.0) for x in row[1 : 1 + len(fields)]], strict=True))
    whole = F.concat(*[F.col(f) for f in fields])
    base, matched, common = F.lit(0.0), F.lit(0).cast("long"), F.lit(-1).cast("long")
    masks = []
    for t, df in zip(terms, row[1 + len(fields) :], strict=True):
        x = sum((w * F.size(F.filter(f, _is(t))) / (1 - b + b * F.size(f) / mean[f]) for f, w in fields.items()), F.lit(0.0))
        idf = math.log(1 + max(0.0, (n - df + 0.5) / (df + 0.5))) if df else 0.0
        place = F.array_position(whole, t)
        on = place > 0
        mask = F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
        base = base + F.when(on, idf * (k1 + 1) * x / (k1 + x)).otherwise(0.0)
        matched = matched + on.cast("long")
        common = common.bitwiseAND(F.when(on, mask).otherwise(F.lit(-1).cast("long")))
        masks.append(mask)
    share = F.size(whole) / sum(mean.values())
    near = F.when(F.col("matched") > 1, 1 + alpha * F.bit_count(common) / F.least(F.col("matched"), F.lit(32)) * F.exp(-decay * share)).otherwise(1.0)
    follows = F.lit(True)
    for m0, m1 in zip(masks, masks[1:], strict=False):
        follows = follows & (F.call_function("shiftleft", m0, F.lit(1)).bitwiseAND(m1) != 0)
    out = docs.withColumn("matched", matched).filter("matched > 0")
    boost = F.when((F.col("matched") == len(terms)) & follows, phrase).otherwise(1.0)
    return out.select("id", (base * near * boost).alias("score"), "matched")


def _is(term: str):
    return lambda x: x == term


def proximity(mentions: DataFrame, anchors: DataFrame, near: float) -> DataFrame:
    """(entity, p): 1 for anchors, ``near`` for entities of a chunk that holds one. mentions: chunk, entity."""
    chunks = mentions.join(anchors, "entity", "left_semi").select("chunk").distinct()
    around = mentions.join(chunks, "chunk", "left_semi").select("entity").distinct().join(anchors, "entity", "left_anti")
    return anchors.select("entity", F.lit(1.0).alias("p")).unionByName(around.select("entity", F.lit(near).alias("p")))


def fuse(lexical: DataFrame, graph: DataFrame, lex_share: float, graph_share: float) -> DataFrame:
    """(chunk, score): lexical (chunk, lex) and graph (chunk, graph) candidates, each over its largest, weighted and summed."""
    most = lexical.agg(F.max("lex").alias("ml")).join(graph.agg(F.max("graph").alias("mg")))
    both = lexical.join(graph, "chunk", "full").join(F.broadcast(most))  # one row
    lex = F.coalesce(F.col("lex"), F.lit(0.0)) / F.col("ml")
    close = F.coalesce(F.col("graph"), F.lit(0.0)) / F.col("mg")
    return both.select("chunk", (lex_share * F.coalesce(lex, F.lit(0.0)) + graph_share * F.coalesce(close, F.lit(0.0))).alias("score"))


def recency(anchor: Column, since: Column, until: Column) -> Column:
    """How late in a window something lies: 0.15 to 0.5, and 0.35 in an empty window."""
    return F.when(until > since, 0.15 + 0.35 * (anchor - since) / (until - since)).otherwise(0.35)


def history_penalty(conflicts: Column, gaps: Column, contradictions: Column) -> Column:
    return F.least(conflicts * 0.16, F.lit(0.5)) + F.least(gaps * 0.12, F.lit(0.4)) + F.least(contradictions * 0.11, F.lit(0.33))


def resolution_score(canonical: Column, alias: Column, strong: Column, block: Column, shape: Column) -> Column:
    """The lexical score of a mention and an entity: name 980, alias 1000, tokens 240 + 90 n, block keys 40 + 15 n, shape 140."""
    some = lambda c, v: F.when(c, v).otherwise(0)
    return some(canonical, 980) + some(alias, 1000) + some(strong > 0, 240 + 90 * strong) + some(block > 0, 40 + 15 * block) + some(shape, 140)


#: The most that each component of an event identity counts.
IDENTITY_CAPS = {"role": 420, "time": 260, "place": 180, "neighbourhood": 220, "discourse": 150, "lexical": 220}


def identity(parts: dict[str, Column]) -> tuple[Column, Column]:
    """(score, kind) of a pair of events from capped components: full, version or none."""
    capped = {k: F.least(F.lit(IDENTITY_CAPS[k]), v) for k, v in parts.items()}
    score = sum(capped.values(), F.lit(0))
    role = capped.get("role", F.lit(0))
    return score, F.when((score >= 920) & (role >= 240), "full").when((score >= 620) & (role >= 120), "version").otherwise("none")


def alias_confidence(text: Column, name: Column) -> Column:
    """1 for the name, 0.9 in other case, less where one contains the other, null otherwise."""
    t, n = F.lower(text), F.lower(name)
    inside = F.when(F.contains(n, t) & (F.length(t) >= 3), 0.6 + 0.2 * F.length(t) / F.length(n)).when(F.contains(t, n), 0.5 + 0.2 * F.length(n) / F.length(t))
    return F.when(text == name, 1.0).when(t == n, 0.9).otherwise(inside)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``n``, their number from 0 on in the order of a column without ties.  Ranges of rows are numbered each by a
    task and start where the ranges before them end; what the driver sees is one count for each range."""
    parts = Scratch(rows.sparkSession, "numbered").table(rows.repartitionByRange(order).withColumn("range_", F.spark_partition_id()))
    starts, so_far = [], 0
    for r in sorted(parts.groupBy("range_").count().collect()):
        starts.append((r[0], so_far))
        so_far += r[1]
    before = rows.sparkSession.createDataFrame(starts, "range_ int, before long")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(order))
    return parts.join(F.broadcast(before), "range_").withColumn("n", F.col("before") + place - 1).drop("range_", "before")
