"""The small graphs and version tables of FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, resolution, versions
from lodestone.plans import textual

F1 = [(0, 1), (1, 2), (0, 3), (1, 4), (3, 4), (4, 5), (3, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(F1, "src long, dst long")


def test_degrees(edges):
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()} == {0: 2, 1: 3, 2: 1, 3: 3, 4: 3, 5: 1, 6: 1}


def test_link_scores(edges):
    r = {(x["a"], x["b"]): x for x in graph.link_scores(edges).collect()}
    assert r[0, 4]["common"] == 2 and (2, 6) not in r
    assert r[0, 4]["jaccard"] == pytest.approx(2 / 3)
    assert r[0, 4]["adamic_adar"] == pytest.approx(2 / math.log(3))


def test_clustering(spark, edges):
    c = {r["node"]: r["coefficient"] for r in graph.clustering(edges).collect()}
    assert c[0] == 0 and c[3] == 0
    three = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert {r["coefficient"] for r in graph.clustering(three).collect()} == {1.0}


def test_hops_and_paths(spark, edges):
    h = graph.hops(edges, spark.createDataFrame([(0,)], "root long"), 3).collect()
    assert [sum(0 < r["hop"] <= k for r in h) for k in (1, 2, 3)] == [2, 5, 6]
    assert len(graph.shortest_path(edges, 0, 5)) == 4
    assert len(graph.shortest_path(edges, 2, 6)) == 5
    assert graph.shortest_path(edges, 0, 0) == [0]
    with pytest.raises(LookupError):
        graph.shortest_path(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"), 1, 3)


def test_ego(spark, edges):
    e = {(r["src"], r["dst"]) for r in graph.ego(edges, spark.createDataFrame([(3,)], "root long"), 1).collect()}
    assert e == {(0, 3), (3, 4), (3, 6)}


def test_components_and_rank(spark, edges):
    assert {r["component"] for r in graph.components(edges).collect()} == {0}
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "node long")
    two = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    assert {(r["node"], r["component"]) for r in graph.components(two, nodes).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (9, 9)}
    p = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert len(p) == 7 and p[1] > p[2] and p[4] > p[5]
    assert len(graph.label_propagation(edges, 5).collect()) == 7


def test_pattern(spark):
    v = spark.createDataFrame([(1, ["Person"]), (2, ["Person"]), (3, ["Dog"])], "node long, labels array<string>")
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    rows = graph.match(v, e, {"a": ["Person"], "b": ["Person"], "c": ["Dog"]}, [("a", "b"), ("b", "c")]).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 3)]
    assert graph.match(v, e, {"a": ["Cat"], "b": ["Person"]}, [("a", "b")]).count() == 0


def test_bitemporal(spark):
    rows = spark.createDataFrame([("n", "River", 0, 50, 10, None), ("n", "River Logistics", 50, None, 20, None)], "id string, name string, valid_from long, valid_to long, recorded_at long, expired_at long")
    at = lambda v, t: [r["name"] for r in versions.bitemporal_view(rows, "id", F.lit(v), F.lit(t)).collect()]
    assert at(25, 15) == ["River"] and at(75, 25) == ["River Logistics"] and at(75, 15) == []


def test_changed(spark):
    s = spark.createDataFrame([("Old", 100, 200), ("New", 200, 400)], "name string, valid_from long, valid_to long")
    assert {(r["name"], r["change"]) for r in versions.changed(s, F.lit(50), F.lit(260)).collect()} == {("Old", "ActivatedAndExpired"), ("New", "Activated")}


def test_catalogue_imports_without_data(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_block_pairs_of_a_common_key(spark, tmp_path):
    parts = [(i, f"red {'blue' if i < 3 else f'w{i}'}", "B", 1) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = {(a, b): 2 if b < 3 else 1 for a in range(60) for b in range(a + 1, 60)}
    assert {(r["left_id"], r["right_id"]): r["n_keys"] for r in textual.entity_block_pairs(spark, str(tmp_path)).collect()} == want
    keys = spark.createDataFrame([(i, w) for i, n, *_ in parts for w in n.split()], "id long, key string")
    got = resolution.block_pairs(keys.select("id").distinct(), keys, piece=7).collect()
    assert len(got) == len(want) and {(r["left_id"], r["right_id"]): r["n_keys"] for r in got} == want


def test_block_pairs_are_spread_from_profiles(spark):
    """Entities of equal keys are paired as one profile: pairs of ids come from lists and are not grouped."""
    from lodestone.operators import resolution

    held = {i: {"x", "y"} if i < 30 else {"y", f"k{i % 3}"} if i < 50 else {"lone"} for i in range(51)}
    keys = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "id long, key string")
    found = resolution.block_pairs(keys.select("id").distinct(), keys, piece=4)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    assert {(r["left_id"], r["right_id"]): r["n_keys"] for r in found.collect()} == want
    assert found.count() == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()[1].strip().startswith(("+- Filter", "+- Generate"))
