"""Trees of summaries against a plain rewrite with the same seeds."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import summary_tree


def draw(*of):
    return (int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:13], 16) + 1) / (1 << 52)


def cos(a, b):
    m = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / m, 9) if m else 0.0


def mean(vs):
    return [round(sum(x) / len(vs), 9) for x in zip(*vs, strict=True)]


def summary(children):
    return " ".join(t for _, t in sorted(((n, t) for n, t in children if t), key=lambda c: (-len(c[1]), c[0])))[:500]


def cluster(grp, level, nodes):
    k = min(4, max(2, len(nodes) // 3))
    cs = [min((draw(42, level, 0, grp, n), n, v) for n, _, v in nodes)[2]]
    for j in range(1, k):
        race = []
        for n, _, v in nodes:
            gap = 1 - max(cos(v, c) for c in cs)
            race.append((-math.log(draw(42, level, j, grp, n)) / gap**2 if gap > 0 else math.inf, n, v))
        cs.append(min(race, key=lambda r: r[:2])[2])
    for _ in range(100):
        of = [int(np.argmax([cos(v, c) for c in cs])) for _, _, v in nodes]
        new = [mean([v for (_, _, v), o in zip(nodes, of, strict=True) if o == i]) if i in of else c for i, c in enumerate(cs)]
        if all(1 - cos(a, b) <= 0.001 for a, b in zip(cs, new, strict=True)):
            break
        cs = new
    return of


def plain_tree(grp, leaves):
    nodes, edges, front, level = {}, set(), [(n, t, v) for n, t, v in leaves if v and any(v)], 0
    while len(front) > 3 and level < 3:
        level += 1
        of = cluster(grp, level, front)
        parents = []
        for c in sorted(set(of)):
            kids = [x for x, o in zip(front, of, strict=True) if o == c]
            edges |= {(n, f"{level}.{c}") for n, _, _ in kids}
            parents.append((f"{level}.{c}", summary([(n, t) for n, t, _ in kids]), mean([v for _, _, v in kids])))
            nodes[f"{level}.{c}"] = (level, parents[-1][1])
        front = parents
    if len(front) > 1:
        edges |= {(n, "root") for n, _, _ in front}
        nodes["root"] = (level + 1, summary([(n, t) for n, t, _ in front]))
    return nodes, edges


@pytest.fixture(scope="module")
def grown(spark):
    r = np.random.default_rng(4)
    rows = []
    for grp, n in (("a", 60), ("b", 7), ("c", 3), ("d", 1), ("e", 25)):
        for i in range(n):
            v = [round(float(x), 6) for x in r.normal(size=6) + 3 * np.eye(6)[i % 5]]
            rows.append((grp, i, "word " * int(r.integers(0, 60)) + str(i), v))
    rows += [("a", 900, None, None), ("a", 901, "zero", [0.0] * 6), ("e", 902, None, [1.0] * 6)]
    return rows, summary_tree.build(spark.createDataFrame(rows, "grp string, id long, text string, v array<float>"))


def test_equals_the_plain_rewrite(grown):
    rows, tree = grown
    nodes, edges = tree.nodes.collect(), tree.edges.collect()
    for grp in "abcde":
        want_nodes, want_edges = plain_tree(grp, [(str(i), t or "", [float(np.float32(x)) for x in v] if v else None) for g, i, t, v in rows if g == grp])
        assert {(e.child, e.parent) for e in edges if e.grp == grp} == want_edges
        assert {n.node: (n.level, n.text) for n in nodes if n.grp == grp and n.level} == want_nodes
    assert max(n.level for n in nodes) == 3 and len(edges) == len({(e.grp, e.child) for e in edges})


def test_search_finds_the_best_leaves_with_parents(spark, grown):
    rows, tree = grown
    asked = [(i, rows[i][3]) for i in (0, 5, 62)]
    got = summary_tree.search(tree, spark.createDataFrame(asked, "query long, qv array<float>"), 5).collect()
    parents = {(e.grp, e.child): e.parent for e in tree.edges.collect()}
    for q, v in asked:
        want = sorted(((-cos([float(np.float32(x)) for x in v], [float(np.float32(x)) for x in u]), g, str(i)) for g, i, _, u in rows if u), key=lambda x: x[0])[:5]
        mine = sorted((x for x in got if x.query == q), key=lambda x: x["rank"])
        assert [(x.grp, x.node) for x in mine] == [w[1:] for w in want]
        assert all(x.parents == parents.get((x.grp, x.node), "") for x in mine)


def test_soft_children_and_empty(spark, grown):
    rows, _ = grown
    leaves = spark.createDataFrame([r for r in rows if r[0] == "a"], "grp string, id long, text string, v array<float>")
    hard = {(e.child, e.parent) for e in summary_tree.build(leaves).edges.collect()}
    soft = {(e.child, e.parent) for e in summary_tree.build(leaves, soft=1.5).edges.collect()}
    assert hard < soft
    empty = summary_tree.build(leaves.limit(0))
    assert empty.nodes.count() == 0 == empty.edges.count()


def test_large_state_is_salted(spark, grown, monkeypatch):
    rows, tree = grown
    monkeypatch.setattr(summary_tree, "BROADCAST_BYTES", 0)
    leaves = spark.createDataFrame([r for r in rows if r[0] == "b"], "grp string, id long, text string, v array<float>")
    assert {tuple(r) for r in summary_tree.build(leaves).edges.collect()} == {tuple(r) for r in tree.edges.filter(F.col("grp") == "b").collect()}
