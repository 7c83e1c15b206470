"""Queries of the store, temporal graphs, resolution and inference rules, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.operators import datalog, graph, ranking, resolution, temporal, versions
from lodestone.plans.catalogue import _t, query
from lodestone.sources import snapshots
from lodestone.streaming import mentions

# ---- the store
@query("SELECT 'nation' AS relation, 0::BIGINT AS n UNION ALL SELECT 'region', count(*) FROM region")
def relation_clear(spark, d):
    store = snapshots.clear({"nation": _t(spark, d, "nation"), "region": _t(spark, d, "region")}, ["nation"])
    one, two = (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("relation"), "n") for n, t in store.items())
    return one.union(two)


@query("""SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 1 ORDER BY c_name, c_custkey""")
def entity_list(spark, d):
    n = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(n, "c_nationkey").select("c_custkey", "c_name", "n_name").orderBy("c_name", "c_custkey")


_PP = "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2"


def _part_edges(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    return a.join(li.filter("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey")


@query(f"WITH e AS ({_PP}), q AS (SELECT p_partkey AS entity FROM part WHERE p_partkey % 100 = 0) SELECT entity, src, dst FROM q JOIN e ON src = entity OR dst = entity")
def edges_of_entity(spark, d):
    """Edges whose source or target is an asked entity: two equi-joins, loops once."""
    e = _part_edges(spark, d).select("src", "dst")
    q = _t(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("entity"))
    out = e.join(q, F.col("src") == F.col("entity")).select("entity", "src", "dst")
    return out.union(e.filter("src <> dst").join(q, F.col("dst") == F.col("entity")).select("entity", "src", "dst"))


@query("SELECT l_orderkey AS thread, p_partkey AS memory, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 100 = 0")
def memories_of_threads(spark, d):
    j = _t(spark, d, "lineitem").filter("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("thread"), F.col("l_partkey").alias("p_partkey"))
    return j.join(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("thread", F.col("p_partkey").alias("memory"), "p_name")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0")
def document_store(spark, d):
    """Hydrated, some documents put again, some removed."""
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    put = versions.upsert(docs, docs.filter("doc_id % 7 = 0").withColumn("lang", F.lit("new")), ["doc_id"])
    return versions.delete_keys(put, docs.filter("doc_id % 11 = 0"), ["doc_id"])


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders, coalesce(last, '-') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def property_attach(spark, d):
    """Properties for hits; those without any get defaults."""
    p = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("last"))
    hits = _t(spark, d, "customer").select("c_custkey", "c_name")
    return hits.join(p, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("last", F.lit("-")).alias("last_status"))


_PROGRAM = """reach(X, Y) :- step(X, Y).
reach(X, Z) :- reach(X, Y), step(Y, Z).
far(X, Y) :- reach(X, Y), X != Y, X < 5."""
_STEP = "step AS (SELECT n_nationkey::BIGINT AS x, ((n_nationkey * 7 + 3) % 25)::BIGINT AS y FROM nation)"
_REACH = f"WITH RECURSIVE {_STEP}, reach AS (SELECT x, y FROM step UNION SELECT r.x, s.y FROM reach r JOIN step s ON s.x = r.y)"


def _steps(spark, d):
    n = F.col("n_nationkey").cast("long")
    return _t(spark, d, "nation").select(n.alias("x"), ((n * 7 + 3) % 25).alias("y"))


@query(_REACH + " SELECT x AS c0, y AS c1 FROM reach WHERE x <> y AND x < 5")
def datalog_script(spark, d):
    return datalog.run(_PROGRAM, {"step": _steps(spark, d)}, "far")


@query(_REACH + " SELECT x AS c0, y AS c1 FROM reach WHERE x = 3")
def named_rule(spark, d):
    """A named rule run from its kept result after another one was invalidated by label."""
    rules = datalog.Rules()
    rules.define("from_three", "reach(X, Y) :- step(X, Y).\nreach(X, Z) :- reach(X, Y), step(Y, Z).\nout(3, Y) :- reach(3, Y).", "out", ["nation"])
    rules.define("one_step", "one(X, Y) :- step(X, Y).", "one", ["step"])
    tables = {"step": _steps(spark, d)}
    rules.run("one_step", tables)
    rules.run("from_three", tables)
    rules.invalidate(label="step")
    return rules.run("from_three", tables).select(F.col("c0").cast("long").alias("c0"), "c1")


# ---- temporal edges: supplier to part, by return flag, from a ship date for a month; every fifth line is timeless
_TE = """te AS (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel, CASE WHEN l_linenumber % 5 <> 0 THEN l_shipdate END AS valid_from,
 CASE WHEN l_linenumber % 5 <> 0 THEN l_shipdate + INTERVAL 30 DAY END AS valid_until FROM lineitem)"""
_IN = "(valid_from IS NULL OR valid_from <= TIMESTAMP '{b}') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{a}')"
_DAY = "1998-06-01 00:00:00"


def _dated(spark, d):
    on = F.col("l_linenumber") % 5 != 0
    at = F.col("l_shipdate").cast("timestamp")
    return _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"),
        F.when(on, at).alias("valid_from"), F.when(on, at + F.expr("INTERVAL 30 DAYS")).alias("valid_until"),
    )


def _time(text: str):
    return F.lit(text).cast("timestamp")


@query(
    f"WITH {_TE}, k AS (SELECT 'strict' AS mode, src, dst FROM te WHERE {_IN.format(a=_DAY, b=_DAY)} AND valid_from IS NOT NULL AND rel IN ('A', 'N') UNION ALL "
    f"SELECT 'snapshot', src, dst FROM te WHERE {_IN.format(a=_DAY, b=_DAY)} AND rel IN ('A', 'N') UNION ALL SELECT 'full', src, dst FROM te WHERE rel IN ('A', 'N')) SELECT mode, src, count(DISTINCT dst) AS neighbours FROM k GROUP BY ALL"
)
def temporal_neighbours(spark, d):
    out = None
    for mode in ("strict", "snapshot", "full"):
        e = temporal.edges_as_of(_dated(spark, d), _time(_DAY), mode, ["A", "N"]).groupBy("src").agg(F.count_distinct("dst").alias("neighbours")).withColumn("mode", F.lit(mode))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"WITH {_TE} SELECT src, dst, rel FROM te WHERE {_IN.format(a='1998-01-01', b='1998-03-31')} AND valid_from IS NOT NULL")
def temporal_during(spark, d):
    return temporal.edges_during(_dated(spark, d), _time("1998-01-01"), _time("1998-03-31"), "strict").select("src", "dst", "rel")


@query(f"WITH {_TE}, e AS (SELECT DISTINCT src, dst FROM te WHERE {_IN.format(a=_DAY, b=_DAY)} AND valid_from IS NOT NULL) SELECT a.src AS a, a.dst AS via, b.src AS b FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src")
def temporal_paths(spark, d):
    """Paths of two edges that hold at one time."""
    e = temporal.edges_as_of(_dated(spark, d), _time(_DAY), "strict").select("src", "dst").distinct()
    a, b = e.select(F.col("src").alias("a"), F.col("dst").alias("via")), e.select(F.col("src").alias("b"), F.col("dst").alias("via"))
    return a.join(b, "via").filter("a < b")


@query(f"WITH {_TE}, e AS (SELECT DISTINCT src, dst FROM te WHERE {_IN.format(a=_DAY, b=_DAY)} AND valid_from IS NOT NULL), k AS (SELECT dst FROM e GROUP BY dst HAVING count(*) >= 2) SELECT src, dst FROM e WHERE dst IN (SELECT dst FROM k)")
def temporal_subgraph(spark, d):
    e = temporal.edges_as_of(_dated(spark, d), _time(_DAY), "strict").select("src", "dst").distinct()
    shared = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("dst")
    return e.join(shared, "dst", "left_semi").select("src", "dst")


# ---- hierarchies, regions, cross-document edges
@query("""WITH t AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
 SELECT child AS node, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT a.child, b.parent, 2 FROM t a JOIN t b ON a.parent = b.child""")
def graph_ancestors(spark, d):
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return graph.ancestors(c.union(n), 3)


@query(f"""WITH e0 AS ({_PP}), e AS (SELECT DISTINCT a AS node, b AS other FROM (SELECT src AS a, dst AS b FROM e0 UNION ALL SELECT dst, src FROM e0) WHERE a <> b), r AS (SELECT p_partkey AS root FROM part WHERE p_partkey % 100 = 0 AND p_partkey IN (SELECT node FROM e)),
 h1 AS (SELECT root, other AS node, 1 AS hop FROM r JOIN e ON node = root), h2 AS (SELECT DISTINCT root, e.other AS node, 2 AS hop FROM h1 JOIN e ON e.node = h1.node WHERE e.other <> root AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.root = h1.root AND x.node = e.other)),
 u AS (SELECT root, root AS node, 0 AS hop FROM r UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2), p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop, node) AS place, count(*) OVER (PARTITION BY root) AS n FROM u)
 SELECT root, node, hop, n > 12 AS truncated FROM p WHERE place <= 12""")
def graph_region(spark, d):
    """The nearest nodes around each root, at most twelve, and whether there were more."""
    e = _part_edges(spark, d)
    roots = graph.both_ways(e).select(F.col("node").alias("root")).distinct().filter("root % 100 = 0")
    return graph.region(e, roots, 2, 12)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS entity FROM lineitem), n AS (SELECT entity, doc AS a, lead(doc) OVER (PARTITION BY entity ORDER BY doc) AS b FROM m)
 SELECT entity, a, b FROM n WHERE b IS NOT NULL""")
def graph_wormholes(spark, d):
    """Edges between documents that name one entity: each document and the next one, in order of the documents."""
    m = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("entity")).distinct()
    return m.withColumn("b", F.lead("a").over(Window.partitionBy("entity").orderBy("a"))).filter("b IS NOT NULL").select("entity", "a", "b")


@query(f"""WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, l_orderkey AS doc FROM (SELECT l_orderkey, a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2)),
 n AS (SELECT a, b FROM e WHERE doc % 5 = 0 GROUP BY ALL), o AS (SELECT a, b FROM e WHERE doc % 5 <> 0 GROUP BY ALL)
 SELECT a, b, 'added' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.a = n.a AND o.b = n.b) UNION ALL SELECT a, b, 'seen' FROM n WHERE EXISTS (SELECT 1 FROM o WHERE o.a = n.a AND o.b = n.b)""")
def graph_delta(spark, d):
    """What the documents of a session add to the graph of the others."""
    e = _part_edges(spark, d).select("l_orderkey", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    new, old = e.filter("l_orderkey % 5 = 0").select("a", "b").distinct(), e.filter("l_orderkey % 5 <> 0").select("a", "b").distinct()
    return new.join(old.withColumn("known", F.lit(True)), ["a", "b"], "left").select("a", "b", F.when(F.col("known"), "seen").otherwise("added").alias("change"))


@query(f"""WITH e AS ({_PP}), g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, src < dst AS up FROM e WHERE src <> dst), p AS (SELECT a, b, up, count(*) AS n FROM g GROUP BY ALL)
 SELECT a, b, sum(n)::BIGINT AS weight, round(1 - exp(sum(ln(1 - least(n * 0.2, 0.9)))), 6) AS confidence FROM p GROUP BY a, b""")
def session_graph_merge(spark, d):
    """Two graphs over one key: weights add up, confidences as a + b - ab."""
    e = _part_edges(spark, d).filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    p = e.groupBy("a", "b", "up").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("a", "b").agg(F.sum("n").alias("weight"), F.round(1 - F.exp(F.sum(F.log(1 - F.least(F.col("n") * 0.2, F.lit(0.9))))), 6).alias("confidence"))


@query(f"""WITH e0 AS ({_PP}), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e0 WHERE src <> dst), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM (SELECT a AS node FROM e UNION SELECT b FROM e))
 SELECT x.k AS src, y.k AS dst FROM e JOIN i x ON x.node = a JOIN i y ON y.node = b""")
def graph_slim_response(spark, d):
    """A graph with its nodes as numbers from 0 on, in order."""
    e = _part_edges(spark, d).filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    i = ranking.numbered(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    return e.join(i.select(F.col("node").alias("a"), F.col("n").alias("src")), "a").join(i.select(F.col("node").alias("b"), F.col("n").alias("dst")), "b").select("src", "dst")


@query("""WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS relations, sum(n)::BIGINT AS facts, string_agg(l_returnflag || ':' || n, ',' ORDER BY n DESC, l_returnflag) AS ledger FROM r GROUP BY l_suppkey""")
def entity_cards(spark, d):
    r = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "l_returnflag")))
    g = r.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("relations"), F.sum("n").alias("facts"), items.alias("x"))
    return g.select("l_suppkey", "relations", "facts", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_returnflag"], (-s["m"]).cast("string"))), ",").alias("ledger"))


@query("SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS sources, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey")
def provenance_union(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("s"))
    return g.select("l_partkey", F.array_join("s", ",").alias("sources"), F.size("s").cast("long").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type, round(max(value) / 100, 6) AS confidence, count(*) AS support, max(ts) AS recent FROM events GROUP BY ALL)
 SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, confidence DESC, support DESC, recent DESC, event_type) AS place FROM s""")
def slot_order(spark, d):
    s = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value") / 100, 6).alias("confidence"), F.count(F.lit(1)).alias("support"), F.max("ts").alias("recent"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    w = Window.partitionBy("user_id").orderBy(rank, F.desc("confidence"), F.desc("support"), F.desc("recent"), "event_type")
    return s.select("user_id", "event_type", F.row_number().over(w).cast("long").alias("place"))


# ---- bi-temporal statements
_H = """h AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def _versions(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return versions.history(o, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(f"WITH {_H} SELECT o_custkey, o_orderkey, o_orderstatus FROM h WHERE valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')")
def entity_timeline(spark, d):
    """The states of all entities that overlap a window."""
    h = _versions(spark, d)
    return h.filter((F.col("valid_from") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit("1996-01-01").cast("timestamp_ntz")))).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {_H} SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'conflict' ELSE 'gap' END AS issue FROM h WHERE o_orderstatus IN ('P', 'O') AND valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')")
def unresolved_issues(spark, d):
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    h = _versions(spark, d).filter(F.col("o_orderstatus").isin("P", "O") & versions.valid_at(at))
    return h.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "conflict").otherwise("gap").alias("issue"))


@query("""WITH c AS (SELECT p_partkey AS id, 1.0::DOUBLE AS score FROM part WHERE p_name = 'red widget' UNION ALL SELECT p_partkey, 0.9 FROM part WHERE lower(p_name) LIKE '%widget' UNION ALL SELECT l_partkey, least(0.8, count(*) / 50.0::DOUBLE) FROM lineitem GROUP BY 1)
 SELECT id, round(max(score), 6) AS score FROM c GROUP BY id ORDER BY score DESC, id LIMIT 8""")
def entity_candidates(spark, d):
    """Canonical names, aliases and mentions; the best score of each entity, the first eight."""
    part = _t(spark, d, "part")
    named = part.filter("p_name = 'red widget'").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("score"))
    alias = part.filter(F.lower("p_name").endswith("widget")).select(F.col("p_partkey").alias("id"), F.lit(0.9).alias("score"))
    said = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.least(F.lit(0.8), F.count(F.lit(1)) / 50.0).alias("score"))
    return ranking.merge_best("id", "score", named, alias, said).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(8)


@query("""WITH o AS (SELECT s_suppkey AS node, s_nationkey AS scope, TIMESTAMP '2020-01-01' AS recorded_at, CASE WHEN s_nationkey < 5 THEN TIMESTAMP '2021-01-01' END AS expired_at FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, TIMESTAMP '2021-01-01', NULL FROM supplier WHERE s_nationkey < 5 AND s_suppkey % 2 = 0),
 live AS (SELECT DISTINCT node FROM o WHERE expired_at IS NULL), e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT node FROM live)) SELECT node, scope, recorded_at, expired_at, (SELECT count(*) FROM e WHERE src = node) AS live_edges FROM o""")
def batch_apply(spark, d):
    """Rows of a scope are replaced: old ones expire, new ones are recorded, edges keep live ends only."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("scope"))
    old = s.withColumns({"recorded_at": _time("2020-01-01"), "expired_at": F.lit(None).cast("timestamp")})
    out = temporal.apply_batch(old, s.filter("scope < 5 AND node % 2 = 0"), F.col("scope") < 5, _time("2021-01-01"))
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    live = out.filter("expired_at IS NULL").select("node").distinct()
    n = e.join(live.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("live_edges"))
    out = out.join(n, "node", "left")
    return out.select("node", "scope", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), F.col("expired_at").cast("timestamp_ntz").alias("expired_at"), F.coalesce("live_edges", F.lit(0)).alias("live_edges"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, epoch_us(max(ts)) / 1000000 AS anchor, epoch_us((SELECT min(ts) FROM events)) / 1000000 AS since, epoch_us((SELECT max(ts) FROM events)) / 1000000 AS til FROM events GROUP BY ALL)
 SELECT user_id, event_type, round(1 + 0.2 * least(n, 4) / 4::DOUBLE + CASE WHEN til > since THEN 0.15 + 0.35 * (anchor - since) / (til - since) ELSE 0.35 END - least(0.16 * (n % 4), 0.5) - least(0.12 * (n % 3), 0.4) - least(0.11 * (n % 2), 0.33), 5) AS score FROM s""")
def history_scores(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    ends = F.broadcast(_t(spark, d, "events").agg(F.min(us).alias("since"), F.max(us).alias("til")))  # one row
    s = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(us).alias("anchor")).join(ends)
    n = F.col("n")
    score = 1 + 0.2 * F.least(n, F.lit(4)) / 4 + ranking.recency(F.col("anchor"), F.col("since"), F.col("til")) - ranking.history_penalty(n % 4, n % 3, n % 2)
    return s.select("user_id", "event_type", F.round(score, 5).alias("score"))


# ---- resolution and inference rules
@query("""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS name, string_split(lower(p_name), ' ') AS tok, p_brand AS brand, p_type AS kind, p_size AS size FROM part),
 c AS (SELECT a.id AS mention, b.id AS entity, a.name = b.name AS canonical, a.brand = b.brand AND a.kind = b.kind AS alias, len(list_intersect(a.tok, b.tok)) AS strong, (a.brand = b.brand)::INTEGER + (a.size = b.size)::INTEGER AS block, a.kind = b.kind AS shape
  FROM p a JOIN p b ON a.brand = b.brand AND a.size = b.size AND a.id <> b.id),
 s AS (SELECT mention, entity, CASE WHEN canonical THEN 980 ELSE 0 END + CASE WHEN alias THEN 1000 ELSE 0 END + CASE WHEN strong > 0 THEN 240 + 90 * strong ELSE 0 END + CASE WHEN block > 0 THEN 40 + 15 * block ELSE 0 END + CASE WHEN shape THEN 140 ELSE 0 END AS score FROM c)
 SELECT mention, entity, score::BIGINT AS score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity) AS place FROM s QUALIFY place <= 5""")
def entity_resolution(spark, d):
    """Candidates of one blocking key, scored by name, alias, token and block overlap; the five best of each mention."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))

    def score(a, b):
        strong = F.size(F.array_intersect(F.split(a + "name", " "), F.split(b + "name", " ")))
        alike = F.col(a + "kind") == F.col(b + "kind")
        return ranking.resolution_score(F.col(a + "name") == F.col(b + "name"), alike, strong, F.lit(2), alike).cast("long")

    return resolution.best_candidates(p, ["brand", "size"], ["name", "kind"], score, 5)


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS tm FROM events), n AS (SELECT *, lead(event_id) OVER w AS o_id, lead(value) OVER w AS o_value, lead(props) OVER w AS o_props, lead(tm) OVER w AS o_tm FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY tm, event_id)),
 s AS (SELECT event_id AS a, o_id AS b, least(420, 180 + 40) AS role, least(260, CASE WHEN o_tm - tm <= 3600000000 THEN 260 WHEN o_tm - tm <= 86400000000 THEN 130 ELSE 0 END) AS time, least(180, CASE WHEN props = o_props THEN 180 ELSE 0 END) AS place, least(220, CASE WHEN abs(value - o_value) < 5 THEN 220 ELSE 40 END) AS around FROM n WHERE o_id IS NOT NULL)
 SELECT a, b, (role + time + place + around)::BIGINT AS score, CASE WHEN role + time + place + around >= 920 AND role >= 240 THEN 'full' WHEN role + time + place + around >= 620 AND role >= 120 THEN 'version' ELSE 'none' END AS identity FROM s""")
def event_identity(spark, d):
    """Neighbouring events of one participant and predicate, by capped components."""
    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    e = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    n = e.select("event_id", "value", "props", "at", *[F.lead(c).over(w).alias(f"o_{c}") for c in ("event_id", "value", "props", "at")]).filter("o_event_id IS NOT NULL")
    gap = F.col("o_at") - F.col("at")
    parts = {
        "role": F.lit(220), "time": F.when(gap <= 3_600_000_000, 260).when(gap <= 86_400_000_000, 130).otherwise(0), "place": F.when(F.col("props") == F.col("o_props"), 180).otherwise(0),
        "neighbourhood": F.when(F.abs(F.col("value") - F.col("o_value")) < 5, 220).otherwise(40),
    }
    score, kind = ranking.identity(parts)
    return n.select(F.col("event_id").alias("a"), F.col("o_event_id").alias("b"), score.cast("long").alias("score"), kind.alias("identity"))


_CLAIMS = """c AS (SELECT o_custkey AS entity, o_orderpriority[1:1] AS slot, o_orderstatus AS value, o_orderdate AS valid_from, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN 'contradicted' WHEN o_orderkey % 2 = 0 THEN 'supported' ELSE 'candidate' END AS status FROM orders)"""


@query(f"""WITH {_CLAIMS}, p AS (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY valid_from DESC, seq DESC) AS place, count(*) OVER (PARTITION BY entity, slot) AS claims, lead(value) OVER (PARTITION BY entity, slot ORDER BY valid_from DESC, seq DESC) AS before FROM c WHERE status <> 'contradicted'),
 k AS (SELECT entity, slot, count(*) FILTER (status = 'contradicted') AS against, count(*) AS n, count(*) FILTER (status <> 'contradicted') AS positive FROM c GROUP BY ALL)
 SELECT k.entity, k.slot, value AS winner, coalesce(claims - 1, 0)::BIGINT AS superseded, CASE WHEN positive = 0 THEN 'gap' WHEN against > 0 THEN 'support_vs_contradiction' WHEN before IS NOT NULL AND before <> value THEN 'delta' ELSE 'none' END AS issue
 FROM k LEFT JOIN p ON p.entity = k.entity AND p.slot = k.slot AND place = 1""")
def memory_compile(spark, d):
    """The winning claim of each slot, how many it supersedes, and what speaks against it."""
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 9 == 0, "contradicted").when(F.col("o_orderkey") % 2 == 0, "supported").otherwise("candidate")
    c = o.select(F.col("o_custkey").alias("entity"), F.substring("o_orderpriority", 1, 1).alias("slot"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("seq"), status.alias("status"))
    good = F.col("status") != "contradicted"
    item = F.when(good, F.struct("valid_from", "seq", "value"))
    k = c.groupBy("entity", "slot").agg(F.count_if(~good).alias("against"), F.count_if(good).alias("positive"), F.reverse(F.array_sort(F.collect_list(item))).alias("x"))
    value, before = F.get("x", F.lit(0))["value"], F.get("x", F.lit(1))["value"]
    issue = F.when(F.col("positive") == 0, "gap").when(F.col("against") > 0, "support_vs_contradiction").when(before.isNotNull() & (before != value), "delta").otherwise("none")
    return k.select("entity", "slot", value.alias("winner"), F.greatest(F.col("positive") - 1, F.lit(0)).cast("long").alias("superseded"), issue.alias("issue"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS support, count(*) FILTER (value < 10) AS conflicts, count(DISTINCT props) AS docs FROM events GROUP BY ALL)
 SELECT user_id, event_type, support, conflicts, CASE WHEN event_type = 'signup' THEN 'Active' WHEN event_type = 'click' THEN CASE WHEN support >= 2 AND conflicts = 0 THEN 'Candidate' ELSE 'Unchanged' END WHEN event_type = 'purchase' THEN CASE WHEN support >= 2 THEN 'Stable' ELSE 'Active' END
  WHEN support >= 2 AND conflicts = 0 THEN 'Active' WHEN support >= 1 THEN 'Candidate' ELSE 'Unchanged' END AS status FROM s""")
def slot_promotion(spark, d):
    s = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("value") < 10).alias("conflicts"))
    sure = (F.col("support") >= 2) & (F.col("conflicts") == 0)
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "Active").when(kind == "click", F.when(sure, "Candidate").otherwise("Unchanged")).when(kind == "purchase", F.when(F.col("support") >= 2, "Stable").otherwise("Active"))
        .when(sure, "Active").when(F.col("support") >= 1, "Candidate").otherwise("Unchanged")
    )
    return s.select("user_id", "event_type", "support", "conflicts", status.alias("status"))


@query("""WITH a AS (SELECT user_id AS event, count(DISTINCT CASE WHEN event_type = 'purchase' THEN date_trunc('day', ts) END) AS explicit, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS document_date, count(*) AS neighbours FROM events GROUP BY 1)
 SELECT event, CASE WHEN explicit > 1 THEN 'conflict' WHEN explicit = 1 THEN 'interval' WHEN document_date = 1 THEN 'underspecified' ELSE 'missing_anchor' END AS outcome, neighbours <= 1 AS unordered FROM a""")
def temporal_solve(spark, d):
    """What an event's anchors allow: an interval, a conflict or a kind of gap."""
    e = _t(spark, d, "events").groupBy(F.col("user_id").alias("event")).agg(
        F.count_distinct(F.when(F.col("event_type") == "purchase", F.date_trunc("day", "ts"))).alias("explicit"), F.max((F.col("event_type") == "signup").cast("int")).alias("dated"), F.count(F.lit(1)).alias("n"),
    )
    outcome = F.when(F.col("explicit") > 1, "conflict").when(F.col("explicit") == 1, "interval").when(F.col("dated") == 1, "underspecified").otherwise("missing_anchor")
    return e.select("event", outcome.alias("outcome"), (F.col("n") <= 1).alias("unordered"))


@query("""WITH l AS (SELECT event_id AS target, lag(event_id) OVER w AS source, value / 100 AS confidence, event_type AS kind, user_id AS doc, lag(event_type) OVER w AS skind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT * FROM l WHERE source IS NOT NULL AND kind <> 'error')
 SELECT a.source AS first, a.target AS via, b.target AS last, round((a.confidence + b.confidence) / 2, 6) AS confidence, a.kind = 'purchase' AND b.kind = 'purchase' AS supported FROM e a JOIN e b ON a.target = b.source AND a.doc = b.doc""")
def causal_chains(spark, d):
    """Two links in a row within one document, with their mean confidence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").select(F.col("user_id").alias("doc"), F.lag("event_id").over(w).alias("source"), F.col("event_id").alias("target"), (F.col("value") / 100).alias("c"), F.col("event_type").alias("kind"))
    e = e.filter("source IS NOT NULL AND kind <> 'error'")
    b = e.select("doc", F.col("source").alias("target"), F.col("target").alias("last"), F.col("c").alias("c2"), F.col("kind").alias("kind2"))
    return e.join(b, ["doc", "target"]).select(F.col("source").alias("first"), F.col("target").alias("via"), "last", F.round((F.col("c") + F.col("c2")) / 2, 6).alias("confidence"), ((F.col("kind") == "purchase") & (F.col("kind2") == "purchase")).alias("supported"))


@query("""SELECT a.l_orderkey AS doc, a.l_partkey AS head, b.l_partkey AS tail, round(0.28 + 0.32 * least(a.l_quantity, b.l_quantity) / 50 + 0.34 / (1 + (b.l_linenumber - a.l_linenumber) / 80.0::DOUBLE) + CASE WHEN a.l_returnflag = b.l_returnflag THEN 0.06 ELSE 0 END + 0.08, 6) AS score
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber AND b.l_linenumber - a.l_linenumber <= 2""")
def relation_seeds(spark, d):
    """Pairs of mentions in a window, seeded by name quality, distance and kind."""
    li = _t(spark, d, "lineitem")
    side = lambda s: li.select(F.col("l_orderkey").alias("doc"), *[F.col(c).alias(f"{s}_{n}") for c, n in (("l_partkey", "id"), ("l_linenumber", "at"), ("l_quantity", "q"), ("l_returnflag", "kind"))])
    p = side("a").join(side("b"), "doc").filter((F.col("b_at") > F.col("a_at")) & (F.col("b_at") - F.col("a_at") <= 2))
    score = 0.28 + 0.32 * F.least("a_q", "b_q") / 50 + 0.34 / (1 + (F.col("b_at") - F.col("a_at")) / 80.0) + F.when(F.col("a_kind") == F.col("b_kind"), 0.06).otherwise(0.0) + 0.08
    return p.select("doc", F.col("a_id").alias("head"), F.col("b_id").alias("tail"), F.round(score, 6).alias("score"))


@query("""WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations), s AS (SELECT *, (so_far // 1000)::BIGINT AS part, lag((so_far // 1000)::BIGINT, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM r)
 SELECT conv_id, turn, part AS observations FROM s WHERE part > was""")
def observe_threshold(spark, d):
    """The turns at which a thread has gathered another thousand characters to observe."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = _t(spark, d, "conversations").withColumn("part", F.floor(F.sum(F.length("text")).over(w) / 1000)).withColumn("was", F.lag("part", 1, 0).over(w))
    return r.filter("part > was").select("conv_id", "turn", F.col("part").alias("observations"))


@query("""WITH n AS (SELECT c_custkey AS id, lower(c_name) AS name FROM customer), q AS (SELECT c_custkey AS mention, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN c_name || ' jr' ELSE c_name[10:] END AS text, c_name FROM customer)
 SELECT mention, id AS entity, round(CASE WHEN text = c_name THEN 1.0 WHEN lower(text) = name THEN 0.9 WHEN contains(name, lower(text)) AND length(text) >= 3 THEN 0.6 + 0.2 * length(text) / length(name) ELSE 0.5 + 0.2 * length(name) / length(text) END::DOUBLE, 6) AS confidence FROM q JOIN n ON id = mention""")
def alias_resolution(spark, d):
    """How sure a mention's text names an entity."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.col("c_name")).when(k == 1, F.lower("c_name")).when(k == 2, F.concat("c_name", F.lit(" jr"))).otherwise(F.expr("substring(c_name, 10)"))
    return c.select(F.col("c_custkey").alias("mention"), F.col("c_custkey").alias("entity"), F.round(ranking.alias_confidence(text, F.col("c_name")), 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS lacking FROM events")
def json_extraction(spark, d):
    """Fields of JSON texts; what does not parse gives nulls."""
    p = F.from_json("props", "k long, missing string", {"mode": "PERMISSIVE"})
    return _t(spark, d, "events").select("event_id", p["k"].alias("k"), p["missing"].isNull().alias("lacking"))


@query("SELECT p_partkey, round(p_retailprice * (1 + 0.5 * pow(p_size - 1, 0.6)), 4) AS scaled FROM part")
def level_scaling(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * (1 + 0.5 * F.pow(F.col("p_size") - 1, F.lit(0.6))), 4).alias("scaled"))


@query("""WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y, dayofyear(o_orderdate) - 1 AS doy FROM orders), l AS (SELECT *, (y % 4 = 0 AND y % 100 <> 0) AS leap FROM y)
 SELECT o_orderkey, leap, (360 + leap::INTEGER)::BIGINT AS days, (doy % 10)::BIGINT AS weekday, least(doy // 30, 11)::BIGINT AS month, round((doy / 29.5::DOUBLE + 0.25) % 1, 6) AS moon, CASE WHEN y BETWEEN 1992 AND 1995 THEN 'first' WHEN y BETWEEN 1996 AND 1998 THEN 'second' ELSE 'late' END AS era FROM l""")
def custom_calendar(spark, d):
    """A calendar of twelve months of 30 days with a leap rule, weeks of ten days, a moon and eras."""
    y, doy = F.year("o_orderdate"), F.dayofyear("o_orderdate") - 1
    leap = (y % 4 == 0) & (y % 100 != 0)
    era = F.when(y.between(1992, 1995), "first").when(y.between(1996, 1998), "second").otherwise("late")
    return _t(spark, d, "orders").select(
        "o_orderkey", leap.alias("leap"), (360 + leap.cast("int")).cast("long").alias("days"), (doy % 10).cast("long").alias("weekday"), F.least(F.floor(doy / 30), F.lit(11)).cast("long").alias("month"),
        F.round((doy / 29.5 + 0.25) % 1, 6).alias("moon"), era.alias("era"),
    )


@query("""WITH m AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS total FROM events)
 SELECT user_id, total AS mentions, count(*) AS kept, min(event_id) AS oldest_kept, string_agg(event_type, ',' ORDER BY back) FILTER (back <= 3) AS ring FROM m WHERE back <= 20 GROUP BY user_id, total""")
def mention_registry(spark, d):
    """Each entity's latest twenty mentions, what was trimmed, and a ring of the last three kinds."""
    return mentions.registry(_t(spark, d, "events"), "user_id", "ts", "event_id", "event_type", 20, 3)


@query("""WITH p AS (SELECT l_suppkey, l_orderkey % 2 AS half, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, sum(n)::BIGINT AS n, max(q) AS most FROM p GROUP BY l_suppkey""")
def partial_merge(spark, d):
    """Partial states of two halves, merged."""
    li = _t(spark, d, "lineitem")
    state = lambda k: li.filter(F.col("l_orderkey") % 2 == k).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    return state(0).unionByName(state(1)).groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.max("q").alias("most"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def dirty_scope_recompute(spark, d):
    """A kept aggregate in which only the scopes of late rows are computed again."""
    o = _t(spark, d, "orders")
    early = o.filter("o_orderkey % 50 <> 0")
    roll = lambda t: t.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    kept = Scratch(spark, "rollup").table(roll(early), "kept")
    return mentions.recompute(kept, o, o.filter("o_orderkey % 50 = 0"), "o_custkey", roll)


@query("""WITH s AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NULL THEN 70 WHEN role = lag(role) OVER w THEN 100 WHEN abs(length(text) - lag(length(text)) OVER w) < 200 THEN 85 ELSE 50 END AS raw FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, round(avg(raw), 6) AS flow, count(*) AS parts FROM s GROUP BY conv_id""")
def flow_score(spark, d):
    """Continuity from part to part: a base, more for a shared or a near topic, less for neither."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    was = F.lag("role").over(w)
    near = F.abs(F.length("text") - F.lag(F.length("text")).over(w)) < 200
    raw = F.when(was.isNull(), 70).when(F.col("role") == was, 100).when(near, 85).otherwise(50)
    return _t(spark, d, "conversations").select("conv_id", raw.alias("raw")).groupBy("conv_id").agg(F.round(F.avg("raw"), 6).alias("flow"), F.count(F.lit(1)).alias("parts"))
