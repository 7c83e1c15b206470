"""Trees of summaries: every group's leaves are clustered by k-means, clusters become parents, and so on up to a root.

All groups are clustered at once.  A round is one join of nodes to the centroids of their
group and one aggregation by (group, cluster), so a group with a third of all leaves is spread
like any other; centroids are ``CLUSTERS`` vectors a group.  Starts are drawn as k-means++
draws them, with probability in proportion to the squared distance from the nearest start,
by an exponential race on hashes: the same table gives the same tree.  A parent has the mean
vector of its children and a summary of their longest texts.

Defined results: leaves without a vector, or of zeros only, have no parent; null texts are
empty ones; a group of at most ``LEAST`` leaves has them under a root, a single leaf is a
root of its own; ids are unique within a group; an empty table gives an empty tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.functions import vectors

# Clusters of a level, nodes of a cluster at least, levels, characters of a summary, movement that ends the rounds.
CLUSTERS, LEAST, LEVELS, SUMMARY, SETTLED, ROUNDS = 4, 3, 3, 500, 0.001, 100
SEED = 42
SALTS = 16
BROADCAST_BYTES = 32 << 20
_ROUND = 9  # decimals of similarities and centroids, so that the order of sums does not matter


@dataclass
class Tree:
    """nodes: (grp, node, level, text, v); edges: (grp, child, parent), several parents for a child if assignment is soft."""

    nodes: DataFrame
    edges: DataFrame


def _draw(*of) -> Column:
    """A number in (0, 1] from the hash of its arguments."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *of)), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def _similar(v: str, c: Column) -> Column:
    m = vectors.magnitude(v) * F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.round(F.when(m > 0, F.aggregate(F.zip_with(v, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / m).otherwise(0.0), _ROUND)


def _joined(nodes: DataFrame, by_group: DataFrame, rows: int, width: int) -> DataFrame:
    """nodes with the row of their group: broadcast below a size, else dealt over SALTS so that no group meets in one task."""
    if rows * width <= BROADCAST_BYTES:
        return nodes.join(F.broadcast(by_group), "grp")
    salted = by_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["grp", "salt"]).drop("salt")


def _means(assigned: DataFrame, dim: int) -> DataFrame:
    """(grp, cluster, mean)."""
    sums = assigned.groupBy("grp", "cluster").agg(*[F.round(F.avg(F.get("v", F.lit(i))), _ROUND).alias(f"m{i}") for i in range(dim)])
    return sums.select("grp", "cluster", F.array(*[f"m{i}" for i in range(dim)]).alias("mean"))


def _clusters(nodes: DataFrame, level: int, dim: int, scratch: Scratch, clusters: int, least: int) -> DataFrame:
    """(grp, node, v, cluster, sims) of nodes (grp, node, v) of groups with more than ``least`` of them."""
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    sizes = scratch.table(sizes.select("grp", F.least(F.lit(clusters), F.greatest(F.lit(2), F.floor(F.col("n") / least).cast("int"))).alias("k")), "sizes")
    groups, width = sizes.count(), clusters * dim * 8 + 64
    nodes = scratch.table(_joined(nodes, sizes, groups, width), "active")
    u = _draw(F.lit(SEED), F.lit(level), F.lit(0), F.col("grp").cast("string"), "node")
    state = nodes.groupBy("grp").agg(F.array(F.min_by("v", F.struct(u.alias("u"), F.col("node")))).alias("cs"))
    state = scratch.table(state, "starts")
    for j in range(1, clusters):
        far = _joined(nodes.filter(F.col("k") > j), state, groups, width)
        gap = 1 - F.array_max(F.transform("cs", lambda c: _similar("v", c)))
        u = _draw(F.lit(SEED), F.lit(level), F.lit(j), F.col("grp").cast("string"), "node")
        race = F.when(gap > 0, -F.log(u) / (gap * gap)).otherwise(F.lit(float("inf")))
        more = far.groupBy("grp").agg(F.min_by("v", F.struct(race.alias("race"), F.col("node"))).alias("c"))
        state = scratch.table(state.join(more, "grp", "left").select("grp", F.when(F.col("c").isNull(), F.col("cs")).otherwise(F.array_append("cs", F.col("c"))).alias("cs")), "starts")
    sims = F.transform("cs", lambda c: _similar("v", c))
    nearest = (F.array_position("sims", F.array_max("sims")) - 1).cast("int")
    state = state.withColumn("moving", F.lit(True))
    for _ in range(ROUNDS):
        assigned = _joined(nodes, state.filter("moving").select("grp", "cs"), groups, width).select("grp", "v", sims.alias("sims")).select("grp", "v", nearest.alias("cluster"))
        new = _means(assigned, dim).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("new"))  # CLUSTERS entries
        both = state.join(new, "grp", "left")
        fresh = F.transform("cs", lambda c, i: F.coalesce(F.col("new")[i.cast("int")], c))
        moved = F.exists(F.arrays_zip(F.col("cs").alias("a"), fresh.alias("b")), lambda p: _apart(p) > SETTLED)
        step = both.select("grp", "cs", fresh.alias("fresh"), (F.col("moving") & moved).alias("moving"))
        was, state = state, scratch.table(step.select("grp", F.when(F.col("moving"), F.col("fresh")).otherwise(F.col("cs")).alias("cs"), "moving"), "centroids")
        scratch.drop(was)
        if state.filter("moving").isEmpty():
            break
    return _joined(nodes, state.select("grp", "cs"), groups, width).select("grp", "node", "v", "text", sims.alias("sims")).withColumn("cluster", nearest)


def _apart(pair: Column) -> Column:
    a, b = pair["a"], pair["b"]
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.when(size(a) * size(b) > 0, dot / (size(a) * size(b))).otherwise(0.0)


def summaries(children: DataFrame, most: int = SUMMARY) -> DataFrame:
    """(grp, parent, text) of children (grp, parent, node, text): the longest texts first, cut at ``most`` characters."""
    longest = F.row_number().over(Window.partitionBy("grp", "parent").orderBy(F.desc(F.length("text")), "node"))
    # each text takes a character and a blank at least, so more of them are never needed
    top = children.filter(F.length("text") > 0).withColumn("place", longest).filter(F.col("place") <= most // 2 + 1)
    lists = top.groupBy("grp", "parent").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, most).alias("text")))).alias("t"))
    return lists.select("grp", "parent", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), " "), 1, most).alias("text"))


def build(leaves: DataFrame, clusters: int = CLUSTERS, least: int = LEAST, levels: int = LEVELS, soft: float | None = None) -> Tree:
    """The tree of each group of leaves (grp, id, text, v).  Nodes are named by their id, parents ``level.cluster``, a root
    ``root``.  soft: a leaf or node is also the child of clusters whose distance is at most so many times the nearest one's."""
    scratch = Scratch(leaves.sparkSession, "tree", sweep=True)
    v = F.transform(F.col("v"), lambda x: x.cast("double"))
    leaves = leaves.select("grp", F.col("id").cast("string").alias("node"), F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("text"), v.alias("v"))
    leaves = scratch.table(leaves, "leaves")
    front = leaves.filter(F.exists("v", lambda x: x != 0))
    dim = front.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    nodes, edges = [leaves], []
    done = None  # the top nodes of groups that are clustered no more
    for level in range(1, levels + 1):
        many = front.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("grp")
        rest = front.join(many, "grp", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if many.isEmpty():
            front = front.limit(0)
            break
        found = scratch.table(_clusters(front.select("grp", "node", "text", "v"), level, dim, scratch, clusters, least), "clusters")
        name = lambda c: F.concat(F.lit(f"{level}."), c.cast("string"))  # noqa: B023, E731
        of = found.select("grp", "node", "text", "v", name(F.col("cluster")).alias("parent"))
        parents = scratch.table(
            _means(of.withColumnRenamed("parent", "cluster"), dim).join(summaries(of).withColumnRenamed("parent", "cluster"), ["grp", "cluster"], "left")
            .select("grp", F.col("cluster").alias("node"), F.lit(level).alias("level"), F.coalesce("text", F.lit("")).alias("text"), F.col("mean").alias("v")), "parents",
        )
        if soft is None:
            edge = of.select("grp", F.col("node").alias("child"), "parent")
        else:
            close = F.transform("sims", lambda s, i: F.struct(i.alias("c"), (1 - s).alias("d")))
            edge = found.select("grp", F.col("node").alias("child"), "cluster", F.explode(close).alias("x"), (1 - F.array_max("sims")).alias("least"))
            edge = edge.filter((F.col("x.c") == F.col("cluster")) | (F.col("x.d") <= F.col("least") * soft))
            edge = edge.select("grp", "child", name(F.col("x.c")).alias("parent")).join(parents.select("grp", F.col("node").alias("parent")), ["grp", "parent"], "left_semi")
        edges.append(scratch.table(edge.select("grp", "child", "parent"), "edges"))
        nodes.append(parents)
        front = parents
    top = scratch.table((done if done is not None else front.limit(0)).unionByName(front), "top")
    several = top.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    under = top.join(several, "grp", "left_semi").withColumn("parent", F.lit("root"))
    if dim:
        root = _means(under.select("grp", F.col("parent").alias("cluster"), "v"), dim).join(summaries(under), "grp", "left")
        height = under.groupBy("grp").agg((F.max("level") + 1).alias("level"))
        nodes.append(scratch.table(root.join(height, "grp").select("grp", F.lit("root").alias("node"), "level", F.coalesce("text", F.lit("")).alias("text"), F.col("mean").alias("v")), "root"))
        edges.append(under.select("grp", F.col("node").alias("child"), "parent"))
    all_nodes, all_edges = nodes[0], leaves.select("grp", F.col("node").alias("child"), F.lit("").alias("parent")).limit(0)
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    for e in edges:
        all_edges = all_edges.unionByName(e)
    return Tree(all_nodes, scratch.table(all_edges, "all-edges"))


def search(tree: Tree, queries: DataFrame, k: int) -> DataFrame:
    """(query, grp, node, cosine, parents, rank) for queries (query, qv): the inner nodes nearest to a query lead to at most
    max(4 k, 50) groups, their leaves are scored, and the k best are given with the parents that they stand under.
    A query that no inner node answers is held against all leaves."""
    most = max(4 * k, 50)
    numbered = lambda df: df.withColumn("no", F.monotonically_increasing_id())
    scratch = Scratch(queries.sparkSession, "tree-search")
    inner = scratch.table(numbered(tree.nodes.filter("level > 0").select("grp", "node", "v")), "inner")
    asked = scratch.table(queries.select((-1 - F.col("query")).alias("no"), F.col("query").cast("long").alias("query"), F.col("qv").cast("array<double>").alias("v")), "asked")
    near = vectors.nearest(inner, asked, most, "no", "v")
    routed = near.select((-1 - F.col("query")).alias("query"), F.col("id").alias("no")).join(inner.select("no", "grp"), "no").select("query", "grp").distinct()
    leaves = scratch.table(numbered(tree.nodes.filter("level = 0 AND v IS NOT NULL").select("grp", "node", "v")), "leaves")
    # numbers of queries are negative here: no query is taken for a leaf
    to = routed.join(asked.select("query", F.col("v").alias("qv")), "query").withColumn("query", -1 - F.col("query"))
    dealt = lambda df, of: df.withColumn("piece", of)
    rows = dealt(leaves.select(F.col("grp"), F.col("no").alias("id"), "v"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = vectors.meet(rows, dealt(to, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "piece"], k)
    lost = asked.join(routed.select("query").distinct(), "query", "left_anti")
    alone = vectors.nearest(leaves.select("no", "v"), lost.select("no", "v"), k, "no", "v").select("query", "id", "cosine")
    best = vectors.ranked(met.unionByName(alone), k).withColumn("query", -1 - F.col("query"))
    hits = best.join(leaves.select(F.col("no").alias("id"), "grp", "node"), "id")
    above = tree.edges.groupBy("grp", F.col("child").alias("node")).agg(F.concat_ws(",", F.array_sort(F.collect_set("parent"))).alias("parents"))  # CLUSTERS at most
    return hits.join(above, ["grp", "node"], "left").select("query", "grp", "node", "cosine", F.coalesce("parents", F.lit("")).alias("parents"), "rank")
