"""More queries and their DuckDB twins: ranked states, fusion, dictionaries, sequences, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import geometry, vectors
from lodestone.operators import ranking
from lodestone.plans.catalogue import _t, query
from lodestone.sources import snapshots
from lodestone.streaming import mentions


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, max(value) / 100 AS confidence, count(DISTINCT props) AS ev, max(event_id) AS last FROM events GROUP BY ALL),
 r AS (SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'supported' WHEN 'view' THEN 'candidate' ELSE 'noted' END AS status,
  CASE WHEN n % 3 = 0 THEN 'reported' WHEN n % 3 = 1 THEN 'mixed' ELSE 'world' END AS plane, * EXCLUDE (user_id, event_type) FROM s)
 SELECT user_id, event_type, round(1 + CASE status WHEN 'active' THEN 0.95 WHEN 'supported' THEN 1 WHEN 'candidate' THEN 0.65 ELSE 0.2 END
 + least(1, greatest(0, confidence)) * 0.7 + least(n, 4) / 4::DOUBLE * 0.2 + least(ev, 6) / 6::DOUBLE * 0.1
 + least(1.0, CASE WHEN last % 2 = 0 THEN 1.0 ELSE 0.85 END + 0.05) - least((n % 4) * 0.18, 0.45) - least((n % 2) * 0.14, 0.45) - CASE plane WHEN 'reported' THEN 0.35 WHEN 'mixed' THEN 0.45 ELSE 0 END, 6)::DOUBLE AS score FROM r""")
def ranked_states(spark, d):
    s = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 100).alias("confidence"), F.count_distinct("props").alias("ev"), F.max("event_id").alias("last"))
    status = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "purchase", "supported").when(F.col("event_type") == "view", "candidate").otherwise("noted")
    said = F.when(F.col("n") % 3 == 0, F.array(F.lit("reported"))).when(F.col("n") % 3 == 1, F.array(F.lit("planned"), F.lit("asserted"))).otherwise(F.array(F.lit("observed"), F.lit("asserted")))
    end = F.when(F.col("last") % 2 == 1, F.col("last"))
    score = ranking.state_score(F.lit(1.0), status, F.col("confidence"), F.col("n"), F.col("ev"), F.col("last"), end, F.col("n") % 4, F.col("n") % 2, F.lit(0), ranking.truth_plane(said))
    return s.select("user_id", "event_type", F.round(score, 6).alias("score"))


_LEX = "(length(text) - length(replace(text, ' a', ' ')))::DOUBLE"


@query(f"""WITH l AS (SELECT doc_id AS id, {_LEX} AS lex FROM documents), q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
 v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS c FROM embeddings, q)
 SELECT id, round(0.7 * least(coalesce(lex, 0), 10) / 10 + 0.3 * coalesce(greatest(0, least(1, (c + 1) / 2)), 0), 6) AS score FROM l FULL JOIN v USING (id)""")
def hybrid_blend(spark, d):
    lex = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.length("text") - F.length(F.replace("text", F.lit(" a"), F.lit(" ")))).cast("double").alias("lex"))
    e = _t(spark, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("qv")).limit(1))
    vec = e.crossJoin(one).select(F.col("vec_id").alias("id"), vectors.cosine("embedding", "qv").alias("c"))
    return lex.join(vec, "id", "full").select("id", F.round(ranking.blend(F.col("lex"), F.col("c")), 6).alias("score"))


@query("""WITH r AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) - 1 AS rank FROM orders GROUP BY o_custkey QUALIFY rank < 500
 UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS rank FROM orders GROUP BY o_custkey QUALIFY rank < 500)
 SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM r GROUP BY id""")
def rank_fusion(spark, d):
    g = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"))

    def top(c):
        # the 500 best come from a bounded heap in each task; only they are numbered
        return g.orderBy(F.desc(c), "id").limit(500).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "id")) - 1)

    return ranking.reciprocal_rank(top("best"), top("n")).withColumn("score", F.round("score", 9))


@query("SELECT id, max(score) AS score FROM (SELECT l_partkey AS id, l_quantity AS score FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, p_size::DOUBLE FROM part) GROUP BY id")
def merge_best_scores(spark, d):
    a = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"))
    return ranking.merge_best("id", "score", a, _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")))


@query("""WITH res AS (SELECT lang AS query, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
 gold AS (SELECT DISTINCT lang AS query, doc_id AS item, 1 + quality AS grade FROM documents JOIN labels USING (doc_id) WHERE toxic = 0),
 dep AS (SELECT query, max(rank) AS depth FROM res GROUP BY query), i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS place FROM gold),
 b AS (SELECT query, count(*) AS relevant, sum(grade / log2(place + 1)) FILTER (place <= depth) AS ideal FROM i JOIN dep USING (query) GROUP BY query),
 h AS (SELECT query, count(*) AS found, count(grade) AS hits, min(rank) FILTER (grade IS NOT NULL) AS first, coalesce(sum(grade / log2(rank + 1)), 0) AS gain FROM res LEFT JOIN gold USING (query, item) GROUP BY query)
 SELECT query, round(hits / found::DOUBLE, 6) AS precision, round(hits / relevant::DOUBLE, 6) AS recall, round(CASE WHEN hits > 0 THEN 2.0::DOUBLE * hits / (found + relevant) ELSE 0 END, 6) AS f1,
 round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, round(gain / ideal, 6) AS ndcg FROM h JOIN b USING (query)""")
def retrieval_evaluation(spark, d):
    docs = _t(spark, d, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), "n_chars")
    res = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "item"))).filter("rank <= 20").drop("n_chars")
    grade = _t(spark, d, "labels").filter("toxic = 0").select(F.col("doc_id").alias("item"), (1 + F.col("quality")).alias("grade"))
    out = ranking.evaluate(res, docs.join(grade, "item").select("query", "item", "grade").distinct())
    return out.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "reciprocal_rank", "ndcg")))


@query("""WITH p AS (SELECT DISTINCT p_name AS term FROM part) SELECT term, term = 'red widget' AS exact, starts_with(term, 'red') AS prefix, term BETWEEN 'b' AND 'h' AS in_range, levenshtein(term, 'rad widgit') AS distance
 FROM p WHERE starts_with(term, 'red') OR term BETWEEN 'b' AND 'h' OR levenshtein(term, 'rad widgit') <= 2""")
def dictionary_lookup(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    far = F.levenshtein("term", F.lit("rad widgit"))
    start, within = F.startswith("term", F.lit("red")), F.col("term").between("b", "h")
    return p.filter(start | within | (far <= 2)).select("term", (F.col("term") == "red widget").alias("exact"), start.alias("prefix"), within.alias("in_range"), far.cast("long").alias("distance"))


@query("""WITH t AS (SELECT user_id, (event_id // 1000)::BIGINT AS chapter FROM events GROUP BY ALL) SELECT a.user_id, a.chapter FROM t a JOIN t b ON a.user_id = b.user_id AND b.chapter = a.chapter - 1""")
def chapter_carry_over(spark, d):
    t = _t(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 1000).cast("long").alias("chapter")).distinct()
    # one sort of each entity's chapters instead of a join of the table with itself
    return t.withColumn("prev", F.lag("chapter").over(Window.partitionBy("user_id").orderBy("chapter"))).filter("prev = chapter - 1").drop("prev")


@query("""WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) SELECT vec_id, round(list_cosine_similarity(v, nxt), 6) AS similarity FROM x WHERE nxt IS NOT NULL""")
def adjacent_similarity(spark, d):
    x = _t(spark, d, "embeddings").withColumn("nxt", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("nxt IS NOT NULL")
    return x.select("vec_id", F.round(vectors.cosine("embedding", "nxt"), 6).alias("similarity"))


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'user') AS user_turns, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY conv_id""")
def session_statistics(spark, d):
    g = _t(spark, d, "conversations").groupBy("conv_id")
    return g.agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 8")
def strongest_incoming(spark, d):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    return _t(spark, d, "lineitem").withColumn("place", F.row_number().over(w)).filter("place <= 8").select("l_partkey", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND b.l_linenumber - a.l_linenumber <= 3 AND a.l_returnflag = b.l_returnflag""")
def proximity_pairs(spark, d):
    li = _t(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("left_line"))
    b = li.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("right_line"))
    return a.join(b, ["l_orderkey", "l_returnflag"]).filter((F.col("left_line") < F.col("right_line")) & (F.col("right_line") - F.col("left_line") <= 3)).select("l_orderkey", "left_line", "right_line")


@query("""WITH t AS (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT token, count(*) AS n FROM t WHERE token NOT IN ('', 'small', 'red') GROUP BY token HAVING count(*) >= 3""")
def candidate_promotion(spark, d):
    t = _t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token"))
    return t.filter(~F.col("token").isin("", "small", "red")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def concept_orphans(spark, d):
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH c AS (SELECT p_brand, p_type, p_retailprice, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) > 1) SELECT * FROM c""")
def competing_causes(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_type", "p_retailprice", "p_partkey")
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).filter("n > 1").drop("n")


@query("""WITH tf AS (SELECT p_brand AS doc, unnest(string_split(p_name, ' ')) AS term FROM part), c AS (SELECT doc, term, least(count(*), 10) AS n FROM tf GROUP BY ALL), p AS (SELECT term, 1 / (1 + exp(-n)) AS p FROM c)
 SELECT term, round(sum(CASE WHEN p > 1e-6 AND p < 0.999999 THEN -p * ln(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY term""")
def term_entropy(spark, d):
    tf = _t(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("term")).groupBy("p_brand", "term").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("n"))
    p = 1 / (1 + F.exp(-F.col("n")))
    return tf.groupBy("term").agg(F.round(F.sum(F.when((p > 1e-6) & (p < 0.999999), -p * F.log(p)).otherwise(0.0)), 6).alias("entropy"))


@query("""WITH u AS (SELECT o_orderkey, o_orderstatus, NULL::BIGINT AS seq, false AS del FROM orders UNION ALL SELECT o_orderkey, 'J', o_custkey, o_custkey % 5 = 0 FROM orders WHERE o_orderkey % 4 = 0)
 SELECT o_orderkey, o_orderstatus FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC NULLS LAST) = 1 AND NOT del""")
def journal_replay(spark, d):
    o = _t(spark, d, "orders")
    journal = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("J").alias("o_orderstatus"), F.col("o_custkey").alias("seq"), (F.col("o_custkey") % 5 == 0).alias("deleted"))
    return snapshots.replay(o.select("o_orderkey", "o_orderstatus"), journal, ["o_orderkey"])


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY ALL""")
def stream_window_counts(spark, d):
    out = mentions.window_counts(_t(spark, d, "events"), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_BALL = "list_transform(embedding::DOUBLE[], lambda x: x * 0.5 / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))"


@query(f"""WITH x AS (SELECT vec_id, label, {_BALL} AS a FROM embeddings), y AS (SELECT vec_id, a, lead(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM x),
 z AS (SELECT vec_id, a, b, list_distance(a, b) AS dist, list_cosine_similarity(a, b) AS c FROM y WHERE b IS NOT NULL)
 SELECT vec_id, round(acosh(1 + 2 * dist * dist / (0.75 * 0.75)), 5) AS hyperbolic, round(acos(greatest(-1, least(1, c))), 5) AS angle FROM z""")
def curved_distances(spark, d):
    x = _t(spark, d, "embeddings").select("vec_id", "label", geometry.scaled("embedding", F.lit(0.5)).alias("a"))
    y = x.withColumn("b", F.lead("a").over(Window.partitionBy("label").orderBy("vec_id"))).filter("b IS NOT NULL")
    return y.select("vec_id", F.round(vectors.poincare_distance("a", "b"), 5).alias("hyperbolic"), F.round(geometry.geodesic("a", "b"), 5).alias("angle"))


@query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS s FROM embeddings),
 h AS (SELECT q.vec_id AS query, e.vec_id AS id, list_sum(list_transform(list_zip(q.s, e.s), lambda z: abs(z[1] - z[2])))::BIGINT AS hamming, q.v AS qv, e.v AS v FROM b q JOIN b e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
 c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY hamming, id) <= greatest(20, ceil(0.4 * (SELECT count(*) FROM embeddings))))
 SELECT query, id, hamming, round(list_cosine_similarity(qv, v), 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(qv, v), 9) DESC, id) AS rank FROM c QUALIFY rank <= 5""")
def vector_two_stage(spark, d):
    e = _t(spark, d, "embeddings")
    return geometry.two_stage(e, e.filter("vec_id % 100 = 0"), 5, share=0.4).select("query", "id", F.col("hamming").cast("long").alias("hamming"), F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))
