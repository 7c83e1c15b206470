"""Queries over the driver's tables and their DuckDB twins, one pair per operator.

The tables stand in for the engine's own: documents for notes and chunks, events for
episodes and slot states, orders for versioned rows, lineitem for the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import pieces
from lodestone.functions import lexical, text, vectors
from lodestone.operators import graph, versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- the graph: parts and suppliers of all line items, and the first two parts of an order; supplier s is node 10,000,000 + s
def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    a = li.select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst"))
    first = li.filter(F.col("l_linenumber") == 1).select("l_orderkey", F.col("l_partkey").alias("src"))
    second = li.filter(F.col("l_linenumber") == 2).select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.union(first.join(second, "l_orderkey").select("src", "dst"))


_E = """e0 AS (SELECT l_suppkey + 10000000 AS src, l_partkey AS dst FROM lineitem
 UNION ALL SELECT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2),
e AS MATERIALIZED (SELECT DISTINCT node, other FROM (SELECT src AS node, dst AS other FROM e0 UNION ALL SELECT dst, src FROM e0) WHERE node <> other),
deg AS MATERIALIZED (SELECT node, count(*) AS degree FROM e GROUP BY node)"""


@query(f"WITH {_E} SELECT node, degree, round(degree / greatest(1, (SELECT count(*) FROM deg) - 1)::DOUBLE, 9) AS centrality FROM deg")
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(
    f"""WITH {_E}, p AS (SELECT x.other AS a, y.other AS b, count(*) AS common, sum(CASE WHEN degree > 1 THEN 1 / ln(degree) END) AS aa, sum(1.0::DOUBLE / degree) AS ra
 FROM e x JOIN e y ON x.node = y.node AND x.other <> y.other AND x.other % 100 = 0 JOIN deg ON deg.node = x.node GROUP BY ALL)
 SELECT a, b, common, round(common / (da.degree + db.degree - common)::DOUBLE, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource, (da.degree * db.degree)::BIGINT AS preferential
 FROM p JOIN deg da ON da.node = a JOIN deg db ON db.node = b"""
)
def graph_link_scores(spark, d):
    e = _edges(spark, d)
    asked = graph.nodes(e).filter("node % 100 = 0")
    return graph.link_scores(e, asked).withColumns({c: F.round(c, 6) for c in ("jaccard", "adamic_adar", "resource")})


@query(
    f"""WITH {_E}, t AS (SELECT x.node AS a, x.other AS b, y.other AS c FROM e x JOIN e y ON x.other = y.node AND x.node < x.other AND y.node < y.other JOIN e z ON z.node = x.node AND z.other = y.other),
 n AS (SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node)
 SELECT deg.node, coalesce(triangles, 0) AS triangles, round(2 * coalesce(triangles, 0) / (degree * (degree - 1))::DOUBLE, 9) AS coefficient FROM deg LEFT JOIN n USING (node) WHERE degree > 1"""
)
def graph_clustering(spark, d):
    return graph.clustering(_edges(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


_HOPS = f"""WITH RECURSIVE {_E}, r AS (SELECT node AS root FROM deg WHERE node % 100 = 0),
h0 AS (SELECT root, root AS node, 0 AS hop, NULL::BIGINT AS parent FROM r)""" + "".join(
    f""", h{k} AS MATERIALIZED (SELECT * FROM h{k - 1} UNION ALL SELECT h.root, e.other, {k}, min(h.node) FROM h{k - 1} h JOIN e ON e.node = h.node
 WHERE h.hop = {k - 1} AND NOT EXISTS (SELECT 1 FROM h{k - 1} s WHERE s.root = h.root AND s.node = e.other) GROUP BY ALL)"""
    for k in (1, 2)
)


@query(_HOPS + " SELECT * FROM h2")
def graph_k_hop(spark, d):
    e = _edges(spark, d)
    roots = graph.nodes(e).filter("node % 100 = 0").select(F.col("node").alias("root"))
    return graph.hops(e, roots, 2)


@query(
    _HOPS.replace("h0 AS (SELECT root", "h0 AS (SELECT root")
    + " SELECT a.root, e.node AS src, e.other AS dst FROM e JOIN h1 a ON a.node = e.node JOIN h1 b ON b.node = e.other AND a.root = b.root WHERE e.node < e.other"
)
def graph_ego_network(spark, d):
    e = _edges(spark, d)
    roots = graph.nodes(e).filter("node % 100 = 0").select(F.col("node").alias("root"))
    return graph.ego(e, roots, 1)


def _chain(first: str, step: str, n: int) -> str:
    return f"WITH {_E}, r0 AS MATERIALIZED ({first})" + "".join(f", r{k} AS MATERIALIZED ({step.format(r=f'r{k - 1}')})" for k in range(1, n + 1))


@query(
    _chain("SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS rank FROM deg", "SELECT deg.node, 0.15 / (SELECT count(*) FROM deg)::DOUBLE + 0.85 * coalesce(g, 0) AS rank FROM deg LEFT JOIN (SELECT other AS node, sum(rank / degree) AS g FROM e JOIN {r} r USING (node) JOIN deg USING (node) GROUP BY other) USING (node)", 12)
    + " SELECT node, round(rank * 1000, 6) AS rank FROM r12"
)
def graph_pagerank(spark, d):
    return graph.pagerank(_edges(spark, d), 12).withColumn("rank", F.round(F.col("rank") * 1000, 6))


@query(
    _chain("SELECT node, CASE WHEN node IN (SELECT min(node) FROM deg) THEN 1.0 ELSE 0.0 END::DOUBLE AS rank FROM deg", "SELECT deg.node, 0.15 * (CASE WHEN deg.node IN (SELECT min(node) FROM deg) THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.85 * coalesce(g, 0) AS rank FROM deg LEFT JOIN (SELECT other AS node, sum(rank / degree) AS g FROM e JOIN {r} r USING (node) JOIN deg USING (node) GROUP BY other) USING (node)", 6)
    + " SELECT node, round(rank * 1000, 6) AS rank FROM r6"
)
def graph_personalised_pagerank(spark, d):
    e = _edges(spark, d)
    seed = graph.nodes(e).agg(F.min("node").alias("node")).withColumn("weight", F.lit(1.0))
    return graph.pagerank(e, 6, seeds=seed).withColumn("rank", F.round(F.col("rank") * 1000, 6))


@query(_chain("SELECT node, node AS component FROM deg", "SELECT node, least(component, coalesce(m, component)) AS component FROM {r} LEFT JOIN (SELECT e.node, min(component) AS m FROM e JOIN {r} r ON r.node = e.other GROUP BY e.node) USING (node)", 24) + " SELECT node, component FROM r24")
def graph_components(spark, d):
    return graph.components(_edges(spark, d))


@query(
    _chain("SELECT node, node AS label FROM deg", "SELECT node, arg_min(label, (-n, label)) AS label FROM (SELECT e.node, label, count(*) AS n FROM e JOIN {r} r ON r.node = e.other GROUP BY ALL) GROUP BY node", 4)
    + " SELECT node, label FROM r4"
)
def graph_label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d), 4)


@query(
    f"""WITH {_E}, v AS (SELECT node, CASE WHEN node >= 10000000 THEN 'supplier' ELSE 'part' END AS label FROM deg)
 SELECT x.node AS a, y.node AS b, z.node AS c FROM e ab JOIN e bc ON ab.other = bc.node JOIN v x ON x.node = ab.node AND x.label = 'supplier' AND x.node % 100 = 0
 JOIN v y ON y.node = ab.other AND y.label = 'part' JOIN v z ON z.node = bc.other AND z.label = 'supplier'"""
)
def graph_pattern_match(spark, d):
    e = _edges(spark, d)
    v = graph.both_ways(e).select("node").distinct().withColumn("labels", F.array(F.when(F.col("node") >= 10_000_000, "supplier").otherwise("part"), F.when(F.col("node") % 100 == 0, "asked").otherwise("")))
    return graph.match(v, e, {"a": ["supplier", "asked"], "b": ["part"], "c": ["supplier"]}, [("a", "b"), ("b", "c")])


@query(
    """WITH d AS (SELECT DISTINCT n_nationkey::BIGINT AS src, (n_nationkey * 7 + 3) % 25::BIGINT AS dst FROM nation), t AS (SELECT 0::BIGINT AS target),
 p1 AS (SELECT target, [src, dst] AS path FROM t JOIN d ON dst = target WHERE src <> dst),
 p2 AS (SELECT target, list_concat([src], path) AS path FROM p1 JOIN d ON dst = path[1] WHERE NOT list_contains(path, src)),
 p3 AS (SELECT target, list_concat([src], path) AS path FROM p2 JOIN d ON dst = path[1] WHERE NOT list_contains(path, src))
 SELECT target, array_to_string(path, '>') AS path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""
)
def graph_paths_back(spark, d):
    n = F.col("n_nationkey").cast("long")
    e = _t(spark, d, "nation").select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst"))
    p = graph.paths_back(e, spark.range(1).select(F.col("id").alias("target")), 3)
    return p.select("target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# ---- versions: each order is a version of its customer's row
_H = """h AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from, row_number() OVER w AS version, lead(o_orderdate) OVER w AS valid_to
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_AT = "TIMESTAMP '1997-01-01 00:00:00'"


def _history(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return versions.history(o, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(f"WITH {_H} SELECT o_custkey, o_orderkey, o_orderstatus, version, valid_from, valid_to, valid_to IS NULL AS is_current FROM h")
def versions_history(spark, d):
    return _history(spark, d)


@query(f"WITH {_H} SELECT o_custkey, o_orderkey, o_orderstatus, version FROM h WHERE valid_from <= {_AT} AND (valid_to IS NULL OR valid_to > {_AT}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) = 1")
def versions_as_of(spark, d):
    return versions.as_of(_history(spark, d), "o_custkey", F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("o_custkey", "o_orderkey", "o_orderstatus", "version")


@query(f"""WITH {_H}, c AS (SELECT *, valid_from >= {_AT} AND valid_from < TIMESTAMP '1997-07-01' AS a, coalesce(valid_to > {_AT} AND valid_to <= TIMESTAMP '1997-07-01', false) AS x FROM h)
 SELECT o_orderkey, CASE WHEN a AND x THEN 'ActivatedAndExpired' WHEN a THEN 'Activated' ELSE 'Expired' END AS change FROM c WHERE a OR x""")
def versions_changed(spark, d):
    return versions.changed(_history(spark, d), F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1997-07-01 00:00:00'")).select("o_orderkey", "change")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, o_orderkey % 7 = 0 AS old FROM orders) WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND NOT old QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def bitemporal_view(spark, d):
    o = _t(spark, d, "orders")
    never = F.lit(None).cast("timestamp_ntz")
    gone = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate"))
    r = o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), never.alias("valid_to"), F.col("o_orderdate").alias("recorded_at"), gone.alias("expired_at"), F.struct("o_orderdate", "o_orderkey").alias("last"))
    at = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return versions.bitemporal_view(r, "o_custkey", at, at, "last").select("o_custkey", "o_orderkey")


@query("""WITH i AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS s, epoch_ms(ts) + (value * 1000)::BIGINT AS e FROM events)
 SELECT a.event_id AS left_id, b.event_id AS right_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'click' AND b.event_type <> 'click'""")
def interval_overlap_join(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    i = _t(spark, d, "events").select("event_id", "user_id", "event_type", ms.alias("s"), (ms + F.round(F.col("value") * 1000).cast("long")).alias("e"))
    a = i.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"), F.col("s").alias("as"), F.col("e").alias("ae"))
    b = i.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("right_id"), F.col("s").alias("bs"), F.col("e").alias("be"))
    return versions.overlaps(a, b, ["user_id"], 60_000, "as", "ae", "bs", "be").select("left_id", "right_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 'renamed', n_regionkey FROM nation WHERE n_nationkey % 3 = 0")
def rows_upsert(spark, d):
    n = _t(spark, d, "nation")
    return versions.upsert(n, n.filter("n_nationkey % 3 = 0").withColumn("n_name", F.lit("renamed")), ["n_nationkey"])


@query("SELECT * FROM nation WHERE n_regionkey <> 1")
def rows_delete(spark, d):
    n = _t(spark, d, "nation")
    return versions.delete_keys(n, n.filter("n_regionkey = 1"), ["n_nationkey"])


# ---- scans, filters, aggregates
@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def scan_point_filter(spark, d):
    return _t(spark, d, "documents").filter(F.col("lang") == "de").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def scan_in_list(spark, d):
    return _t(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE (lang IS NULL OR lang <> 'en') AND n_chars BETWEEN 100 AND 5000 AND contains(lower(text), 'the') AND (source = 'src1' OR starts_with(source, 'src1'))")
def filter_algebra(spark, d):
    c = (F.col("lang").isNull() | (F.col("lang") != "en")) & F.col("n_chars").between(100, 5000) & F.lower("text").contains("the") & ((F.col("source") == "src1") | F.col("source").startswith("src1"))
    return _t(spark, d, "documents").filter(c).select("doc_id")


@query("SELECT 'documents' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def relation_counts(spark, d):
    out = None
    for r in ("documents", "events", "orders"):
        one = _t(spark, d, r).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("relation"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_id, ts, event_type FROM events WHERE event_type LIKE '%e%' OR props LIKE '%7%' ORDER BY ts DESC, event_id LIMIT 50")
def episode_search(spark, d):
    e = _t(spark, d, "events").filter(F.col("event_type").contains("e") | F.col("props").contains("7"))
    return e.select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(50)


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn > (SELECT avg(turn) FROM conversations WHERE conv_id = c.conv_id)")
def messages_since_watermark(spark, d):
    c = _t(spark, d, "conversations")
    mark = c.groupBy("conv_id").agg(F.avg("turn").alias("mark"))
    return c.join(mark, "conv_id").filter(F.col("turn") > F.col("mark")).select("conv_id", "turn", "role")


@query("""WITH p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT l_orderkey) AS n FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY ALL)
 SELECT a, b, n, round(n / (SELECT max(n) FROM p)::DOUBLE, 6) AS confidence FROM p WHERE n >= 2""")
def cooccurrence_edges(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = li.select("l_orderkey", F.col("l_partkey").alias("b"))
    n = F.count(F.lit(1))
    parts = pieces(spark, li.groupBy("l_orderkey").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0])
    pairs = li.withColumnRenamed("l_partkey", "a").join(other, "l_orderkey").filter(F.col("a") < F.col("b"))
    p = pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    most = p.agg(F.max("n").alias("most"))
    return p.filter(F.col("n") >= 2).join(F.broadcast(most)).select("a", "b", "n", F.round(F.col("n") / F.col("most"), 6).alias("confidence"))


@query("SELECT l_suppkey, l_returnflag, round(1 - exp(sum(ln(1 - l_discount))), 6) AS confidence, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def merge_noisy_or(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag")
    return g.agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("l_discount")))), 6).alias("confidence"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT user_id, event_type, count(*) AS n, round(max(value), 6) AS best, min(ts) AS first_ts, max(ts) AS last_ts, round(stddev_pop(value), 5) AS spread FROM events GROUP BY ALL")
def slot_support(spark, d):
    g = _t(spark, d, "events").groupBy("user_id", "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("best"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.stddev_pop("value"), 5).alias("spread"))


@query("WITH m AS (SELECT user_id, event_type, max(event_id) AS seq FROM events GROUP BY ALL) SELECT user_id, event_type, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS place FROM m QUALIFY place <= 3")
def recency_ring(spark, d):
    m = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("seq"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seq")))).filter("place <= 3").withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id, date_trunc('day', ts) AS day, year(ts)::BIGINT AS y, hour(ts)::BIGINT AS h, count(*) AS n FROM events GROUP BY ALL")
def calendar_slice(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.year("ts").cast("long").alias("y"), F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT user_id, ts, event_id, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w > 1800000 THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 y AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, run::BIGINT AS run, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM y GROUP BY user_id, run""")
def consecutive_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    x = _t(spark, d, "events").withColumn("brk", F.when(ms - F.lag(ms).over(w) > 1_800_000, 1).otherwise(0))
    y = x.withColumn("run", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- lexical
@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM t),
 p AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) WHERE term IN ('license', 'version', 'the') GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS score, count(*) AS matched FROM p JOIN f USING (term), s GROUP BY doc_id"""
)
def lexical_bm25(spark, d):
    return lexical.bm25(_t(spark, d, "documents"), ["license", "version", "the"]).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, (strpos(lower(text), 'licensed under') - 1)::BIGINT AS first FROM documents WHERE contains(lower(text), 'licensed under')")
def lexical_phrase(spark, d):
    return lexical.containing(_t(spark, d, "documents"), "licensed under").select("doc_id", F.col("first").cast("long").alias("first"))


@query("""WITH g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i::BIGINT, 3)))) AS gram FROM benchmark) SELECT gram, count(*) AS df FROM g GROUP BY gram""")
def lexical_qgram_index(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.explode_outer(lexical.grams(F.col("text"))).alias("gram")).filter(F.col("gram").isNotNull())
    return b.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


@query("""WITH w AS (SELECT lower(u) AS term FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS u FROM documents) WHERE length(u) >= 4)
 SELECT term, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM w), 4) AS percent FROM w GROUP BY term ORDER BY n DESC, term LIMIT 100""")
def text_keyword_density(spark, d):
    docs = _t(spark, d, "documents")
    return text.keyword_density(docs, lexical.terms_of(F.col("text")), 100)


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS words, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '[^\\n]+'))::BIGINT AS paragraphs,
 ceil(len(regexp_extract_all(text, '[^\\s]+')) / 225.0)::BIGINT AS reading_minutes FROM documents""")
def text_statistics(spark, d):
    s = text.statistics(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", *[s[k].cast("long").alias(k) for k in ("words", "characters", "paragraphs", "reading_minutes")])


# ---- vectors
@query(
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
 SELECT query, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def vector_knn(spark, d):
    v = _t(spark, d, "embeddings")
    return vectors.nearest(v, v.filter("vec_id % 100 = 0"), 10).select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS magnitude, (list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END)))::BIGINT AS ones FROM embeddings")
def vector_magnitude_bits(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.magnitude("embedding"), 6).alias("magnitude"), F.bit_count(vectors.sign_bits("embedding")[0]).cast("long").alias("ones"))


@query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
 SELECT vec_id, round(lo, 6) AS lo, (list_sum(list_transform(v, lambda x: floor((x - lo) / (CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1 END) + 0.5))))::BIGINT AS total FROM b""")
def vector_scalar_quantised(spark, d):
    q = _t(spark, d, "embeddings").select("vec_id", vectors.scalar_quantise("embedding").alias("q"))
    return q.select("vec_id", F.round("q.min", 6).alias("lo"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
