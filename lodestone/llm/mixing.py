"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain / language / source.  Leaf capacity is its tokens times
``max_epochs``; an inner node's capacity is the sum of its children's.  Top down,
a node's budget is split among its children by weight; what a child cannot hold
goes to its siblings (water level over capacity / weight), and only what all
siblings together cannot hold stays with the ancestors' other children.  A leaf
then takes whole epochs and, of one more, the prefix of a seeded order whose
tokens fit.  The prefix is found without sorting a leaf: tokens are summed by
4,096 ranges of the seeded hash, and only the one range where the budget ends is
ordered.

Only DataFrame functions are used.  Defined results: null text has no tokens; a
null domain, language or source is the leaf named ``(null)``; a null id is hashed
as a value of its own; repeated rows count as rows; weights not listed are 1;
weight 0 takes nothing; an empty table gives no rows; other columns stay, whatever
their names (``mix`` replaces columns called like those it adds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._names import fresh

FRACTION = 0.5  # of all tokens, the size of the mixture
MAX_EPOCHS = 4
SEED = 17
#: Weights of the production mixture (parameters of the query; names not listed weigh 1).
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
SOURCE_WEIGHTS: dict[str, float] = {}
LEAF = ["m_domain", "m_lang", "m_source"]


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0)), F.lit(4)).cast("string"))


def _weight(name: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, F.lit(float(v))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], own: str, weights: dict[str, float]) -> DataFrame:
    """Adds ``budget``: how much of ``parent_budget`` each node takes, by water level among siblings."""
    w = Window.partitionBy(*parent, "parent_budget") if parent else Window.partitionBy("parent_budget")
    up = w.orderBy("ratio", own).rowsBetween(Window.unboundedPreceding, -1)
    rest = w.orderBy("ratio", own).rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("w", _weight(own, weights)).withColumn("usable", F.when(F.col("w") > 0, F.col("capacity")).otherwise(F.lit(0)))
    n = n.withColumn("ratio", F.when(F.col("w") > 0, F.col("usable") / F.col("w")).otherwise(F.lit(0.0)))
    n = n.withColumn("rank", F.row_number().over(w.orderBy("ratio", own)))
    n = n.withColumn("level", (F.col("parent_budget") - F.coalesce(F.sum("usable").over(up), F.lit(0))) / F.when(F.sum("w").over(rest) > 0, F.sum("w").over(rest)))
    n = n.withColumn("cut", F.min(F.when(F.col("ratio") > F.col("level"), F.col("rank"))).over(w))
    n = n.withColumn("water", F.max(F.when(F.col("rank") == F.col("cut"), F.col("level"))).over(w))
    n = n.withColumn("budget", F.when(F.col("water").isNull(), F.col("usable")).otherwise(F.least(F.col("usable"), F.floor(F.col("water") * F.col("w")).cast("long"))))
    return n.drop("w", "usable", "ratio", "rank", "level", "cut", "water")


def budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens)."""
    cap = leaves.withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    top = cap.groupBy("m_domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    top = top.withColumn("parent_budget", F.floor(all_tokens * F.lit(float(fraction))).cast("long")).drop("tokens")
    top = _share(top, [], "m_domain", weights[0]).select("m_domain", F.col("budget").alias("parent_budget"))
    mid = cap.groupBy("m_domain", "m_lang").agg(F.sum("capacity").alias("capacity")).join(top, "m_domain")
    mid = _share(mid, ["m_domain"], "m_lang", weights[1]).select("m_domain", "m_lang", F.col("budget").alias("parent_budget"))
    return _share(cap.join(mid, ["m_domain", "m_lang"]), ["m_domain", "m_lang"], "m_source", weights[2]).select("m_domain", "m_lang", "m_source", "tokens", "budget")


#: Columns that ``mix`` adds; columns of the input with these names are replaced.
ADDED = ("m_domain", "m_lang", "m_source", "m_tokens", "m_copies")


def _mixed(docs: DataFrame, fraction: float, max_epochs: int, seed: int, domain: Column | None, weights: tuple[dict, dict, dict], id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with the columns of ADDED under names that docs does not have, and those names.

    The tree of budgets and the ranges in which they end have a row for each leaf; they
    are written once, so that no later plan holds them.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    leaf_names = fresh(docs.columns, "m_domain", "m_lang", "m_source")
    own = [*docs.columns, *leaf_names]
    tokens, copies, full, rest, order, rng, edge, before, total = fresh(own, "m_tokens", "m_copies", "m_full", "m_rest", "m_order", "m_range", "m_edge", "m_before", "m_sum")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    source = F.col("source")
    values = [named(domain if domain is not None else domain_of(source)), named(F.col("lang")), named(source)]
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    d = docs.withColumns(dict(zip(leaf_names, values, strict=True)) | {tokens: words})
    leaves = d.groupBy(*[F.col(c).alias(a) for c, a in zip(leaf_names, LEAF, strict=True)]).agg(F.sum(tokens).alias("tokens"))
    plan = scratch.table(budgets(scratch.table(leaves, "leaves"), fraction, max_epochs, weights), "budgets")
    plan = plan.withColumn(full, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.select(*[F.col(a).alias(c) for c, a in zip(leaf_names, LEAF, strict=True)], full, (F.col("budget") - F.col(full) * F.col("tokens")).alias(rest))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(full).cast("string"), ident)), 1, 15), 16, 10).cast("long")
    d = d.join(plan, leaf_names).withColumn(order, hashed).withColumn(rng, F.shiftright(order, 48))  # 60 bits: 4,096 ranges
    # of each leaf, the one range in which its budget ends: as many rows as leaves
    sums = d.groupBy(*leaf_names, rng, rest).agg(F.sum(tokens).alias(total))
    so_far = Window.partitionBy(*leaf_names).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(total).over(so_far), F.lit(0)))
    sums = sums.filter((F.col(before) <= F.col(rest)) & (F.col(before) + F.col(total) > F.col(rest)))
    ends = scratch.table(sums.select(*leaf_names, F.col(rng).alias(edge), before), "ends")
    d = d.join(ends, leaf_names, "left")
    past = F.coalesce(F.col(rng) < F.col(edge), F.lit(True))
    clear = d.filter(F.col(edge).isNull() | (F.col(rng) != F.col(edge))).withColumn(copies, F.col(full) + past.cast("long"))
    until = Window.partitionBy(*leaf_names).orderBy(order, id_col).rowsBetween(Window.unboundedPreceding, 0)
    last = d.filter(F.col(rng) == F.col(edge))
    last = last.withColumn(copies, F.col(full) + (F.col(before) + F.sum(tokens).over(until) <= F.col(rest)).cast("long"))
    return clear.unionByName(last).drop(full, rest, order, rng, edge, before), [*leaf_names, tokens, copies]


def mix(
    docs: DataFrame,
    fraction: float = FRACTION,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs with m_domain, m_lang, m_source, m_tokens and m_copies (0: not in the mixture)."""
    d, made = _mixed(docs, fraction, max_epochs, seed, domain, weights, id_col, text_col)
    kept = [F.col(c) for c in docs.columns if c.lower() not in ADDED]
    return d.select(*kept, *[F.col(c).alias(a) for c, a in zip(made, ADDED, strict=True)])


def mixture(
    docs: DataFrame,
    fraction: float = FRACTION,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of the mixture with the columns of docs, each as many times as its epochs."""
    d, made = _mixed(docs, fraction, max_epochs, seed, domain, weights, id_col, text_col)
    copies = F.col(made[-1])
    (epoch,) = fresh(d.columns, "m_epoch")
    return d.filter(copies > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("m_tokens").alias("n_tokens"), F.col("m_copies").alias("copies"))


def oracle(fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, docs: str = "documents") -> str:
    case = lambda c, w: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1.0 END" if w else "1.0"

    def share(name: str, rows: str, parent: str, own: str, weights: dict) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_a AS (SELECT *, ({case(own, weights)})::DOUBLE AS w, capacity / ({case(own, weights)})::DOUBLE AS ratio FROM {rows}),
{name}_b AS (SELECT *, row_number() OVER ({part} ORDER BY ratio, {own}) AS rk,
  (parent_budget - coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / sum(w) OVER ({part} ORDER BY ratio, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN ratio > lev THEN rk END) OVER ({part}) AS cut FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN rk = cut THEN lev END) OVER ({part}) AS water FROM {name}_c),
{name} AS (SELECT *, CASE WHEN water IS NULL THEN capacity ELSE least(capacity, floor(water * w)::BIGINT) END AS budget FROM {name}_d)"""

    return f"""
WITH d AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), 0) % 4)::VARCHAR AS domain,
    coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {docs}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {max_epochs} AS capacity FROM d GROUP BY ALL),
t0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, floor((SELECT sum(tokens) FROM leaf)::DOUBLE * {fraction})::BIGINT AS parent_budget FROM leaf GROUP BY domain),
{share("t1", "t0", "", "domain", DOMAIN_WEIGHTS)},
u0 AS (SELECT leaf.domain, leaf.lang, sum(leaf.capacity)::BIGINT AS capacity, any_value(t1.budget) AS parent_budget FROM leaf JOIN t1 USING (domain) GROUP BY ALL),
{share("u1", "u0", "domain", "lang", LANG_WEIGHTS)},
v0 AS (SELECT leaf.*, u1.budget AS parent_budget FROM leaf JOIN u1 USING (domain, lang)),
{share("v1", "v0", "domain, lang", "source", SOURCE_WEIGHTS)},
p AS (SELECT domain, lang, source, budget, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS fullk FROM v1),
h AS (SELECT d.*, fullk, budget - fullk * tokens AS rest,
    ('0x' || substr(md5('{seed}:' || fullk::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT AS k FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM h)
SELECT doc_id, domain, lang, source, n_tokens, (fullk + CASE WHEN so_far <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
