"""Queries of retrieval (lexical, vectors, hybrid, summaries) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.functions import geometry, lexical, qgram, vectors
from lodestone.operators import ranking
from lodestone.plans.catalogue import _t, query

# ---- substring search with coverage and proximity
_QUERY = 'license "version 2.0" apache'
_CLAUSES = lexical.parse_query(_QUERY)


def _search_sql(variant: str, clauses: list[str] = _CLAUSES, docs: str = "documents", keep: str = "") -> str:
    """The score of qgram.search: places from the parts between them (no clause overlaps itself)."""
    grams = [qgram.grams_of(c) for c in clauses]
    stats = ", ".join(f"count(*) FILTER (contains(t, '{g}')) AS g{i}_{j}" for i, gs in enumerate(grams) for j, g in enumerate(gs))
    idf = lambda x: f"CASE WHEN {x} = 0 THEN 0 ELSE ln(1 + greatest(0, (n - {x} + 0.5::DOUBLE) / ({x} + 0.5::DOUBLE))) END"
    weights = ", ".join("greatest(" + ", ".join(idf(f"g{i}_{j}") for j in range(len(gs))) + f") AS w{i}" for i, gs in enumerate(grams))
    split = ", ".join(f"string_split(t, '{c}') AS p{i}" for i, c in enumerate(clauses))
    tfs = ", ".join(f"len(p{i}) - 1 AS tf{i}" for i in range(len(clauses)))
    place = lambda i: f"list_transform(range(1, len(p{i})), lambda k: list_sum(list_transform(p{i}[1:k], lambda x: length(x))) + (k - 1) * {len(clauses[i])})"
    masks = ", ".join(
        f"CASE WHEN tf{i} > 0 THEN list_aggregate(list_transform({place(i)}, lambda a: (1::BIGINT << least(31, (a * 32) // greatest(size, 1))::BIGINT)), 'bit_or') ELSE -1 END AS m{i}"
        for i in range(len(clauses))
    )
    share = "(size / avg)"

    def sat(i: int) -> str:
        if variant == "double":
            x = f"(2.2::DOUBLE * tf{i} / (tf{i} + 1.2::DOUBLE * (0.25 + 0.75 * {share})))"
            return f"{x} / (1 + {x} / 1.2::DOUBLE)"
        x = f"(tf{i} / (0.25 + 0.75 * {share}))"
        return f"2.2::DOUBLE * {x} / (1.2 + {x})"

    base = " + ".join(f"CASE WHEN tf{i} > 0 THEN w{i} * {sat(i)} ELSE 0 END" for i in range(len(clauses)))
    decay = "exp(-0.1)" if variant == "constant" else f"exp(-0.1::DOUBLE * {share})"
    hits = " + ".join(f"(tf{i} > 0)::INTEGER" for i in range(len(clauses)))
    must = " AND ".join(["matched > 0", *(f"tf{i} > 0" for i, c in enumerate(clauses) if " " in c)])
    common = " & ".join(f"m{i}" for i in range(len(clauses)))
    return f"""WITH d AS (SELECT doc_id{keep}, coalesce(lower(text), '') AS t FROM {docs}), s AS (SELECT count(*) AS n, avg(length(t)) AS avg, {stats} FROM d), i AS (SELECT n, avg, {weights} FROM s),
 x AS (SELECT doc_id{keep}, length(t) AS size, {split} FROM d), y AS (SELECT *, {tfs} FROM x), z AS (SELECT *, {masks}, {hits} AS matched FROM y)
 SELECT doc_id{keep}, round(({base}) * pow(0.1 + matched / {len(clauses)}::DOUBLE, 3) * CASE WHEN matched > 1 THEN 1 + 0.5 * bit_count({common}) / least(matched, 32)::DOUBLE * {decay} ELSE 1 END, 6) AS score,
 matched FROM z, i WHERE {must}"""


@query(_search_sql("plain"))
def qgram_search(spark, d):
    return qgram.search(_t(spark, d, "documents"), _QUERY).withColumn("score", F.round("score", 6))


@query(_search_sql("constant"))
def qgram_search_constant_decay(spark, d):
    return qgram.search(_t(spark, d, "documents"), _QUERY, "constant").withColumn("score", F.round("score", 6))


@query(_search_sql("double"))
def gdr_lexical_score(spark, d):
    return qgram.search(_t(spark, d, "documents"), _QUERY, "double").withColumn("score", F.round("score", 6))


@query(_search_sql("plain", ["license", "apache"], "(SELECT * FROM documents WHERE lang = 'en' AND (source = 'src1' OR starts_with(source, 'src1')))", ", source"))
def scoped_note_search(spark, d):
    docs = _t(spark, d, "documents").filter((F.col("lang") == "en") & ((F.col("source") == "src1") | F.col("source").startswith("src1")))
    return qgram.search(docs, "license apache", keep=["source"]).withColumn("score", F.round("score", 6))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id FROM documents WHERE {' AND '.join(f'''contains(lower(text), '{g}')''' for g in qgram.grams_of(c))}" for c in _CLAUSES) + ") SELECT doc_id, count(*)::INTEGER AS clauses FROM c GROUP BY doc_id")
def qgram_candidates(spark, d):
    return qgram.candidates(_t(spark, d, "documents"), _QUERY)


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS clause, '{g}' AS gram, count(*) FILTER (contains(lower(text), '{g}')) AS df FROM documents" for c in _CLAUSES for g in qgram.grams_of(c)) + ") SELECT clause, gram, df FROM g QUALIFY row_number() OVER (PARTITION BY clause ORDER BY df, gram) = 1")
def qgram_selective_gate(spark, d):
    df = qgram.corpus(_t(spark, d, "documents"), _CLAUSES)[2]
    return spark.createDataFrame([(c, qgram.rarest(c, df), df[qgram.rarest(c, df)]) for c in _CLAUSES], "clause string, gram string, df long")


@query("SELECT * FROM (" + _search_sql("plain") + ") WHERE score > 1 ORDER BY score DESC, doc_id LIMIT 20")
def exact_top_hits(spark, d):
    hits = qgram.search(_t(spark, d, "documents"), _QUERY).withColumn("score", F.round("score", 6)).filter("score > 1")
    return hits.orderBy(F.desc("score"), "doc_id").limit(20)


_GRAMS = "SELECT p_partkey AS id, unnest(list_distinct(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(p_name, i::BIGINT, 3)))) AS gram FROM part"


def _part_grams(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(lexical.grams(F.col("p_name"))).alias("gram"))


@query(f"SELECT id FROM ({_GRAMS}) WHERE gram IN ('red', ' wi', 'get') GROUP BY id HAVING count(*) = 3")
def posting_intersection(spark, d):
    p = _part_grams(spark, d).filter(F.col("gram").isin("red", " wi", "get"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("id")


@query(f"""WITH p AS ({_GRAMS}), n AS (SELECT count(*) AS n FROM part), f AS (SELECT gram, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS ub FROM p, n WHERE gram IN ('red', 'blu', 'get') GROUP BY gram, n)
 SELECT id, round(sum(ub), 6) AS upper FROM p JOIN f USING (gram) GROUP BY id""")
def posting_union(spark, d):
    p = _part_grams(spark, d).filter(F.col("gram").isin("red", "blu", "get"))
    n = F.lit(float(_t(spark, d, "part").count()))
    bound = F.broadcast(p.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select("gram", lexical.idf(n, F.col("df")).alias("ub")))  # three rows
    return p.join(bound, "gram").groupBy("id").agg(F.round(F.sum("ub"), 6).alias("upper"))


@query("SELECT doc_id, least(32, greatest(8, ceil(n_chars / 50.0)))::BIGINT AS segments, (SELECT bit_or(1::BIGINT << ((i * least(32, greatest(8, ceil(n_chars / 50.0)))::BIGINT) // 32)) FROM range(0, 32, 5) t(i)) AS mask FROM documents")
def segment_remap(spark, d):
    want = qgram.segments_of(F.col("n_chars"))
    mask = F.lit(sum(1 << i for i in range(0, 32, 5)))
    return _t(spark, d, "documents").select("doc_id", want.cast("long").alias("segments"), qgram.remap(mask, 32, want).alias("mask"))


_SUFFIXES = qgram.SUFFIXES


def _stem_sql() -> str:
    case = " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN w[:length(w) - {len(s)}]" for s in _SUFFIXES)
    twice = " OR ".join(f"ends_with(y, '{c}{c}')" for c in "bcdfghjklmnpqrstvwxyz")
    return f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), c AS (SELECT w, CASE {case} ELSE w END AS c FROM w),
 y AS (SELECT w, CASE WHEN ends_with(c, 'i') AND length(c) > 3 THEN c[:length(c) - 1] || 'y' ELSE c END AS y FROM c)
 SELECT w AS word, CASE WHEN length(w) <= 4 THEN w WHEN length(y) >= 3 AND ({twice}) THEN y[:length(y) - 1] ELSE y END AS root FROM y"""


@query(_stem_sql())
def text_stems(spark, d):
    w = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return w.select("word", qgram.stem(F.col("word")).alias("root"))


# ---- field-weighted terms with proximity: title (part name) weighs 10, body (type and brand) 1
_TERMS = ("red", "widget", "economy")


@query("""WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS title, [lower(p_type), lower(p_brand)] AS body FROM part), n AS (SELECT count(*) AS n, avg(len(title)) AS avt, avg(len(body)) AS avb FROM p),
 t AS (SELECT unnest(['red', 'widget', 'economy']) AS term, unnest([0, 1, 2]) AS k),
 o AS (SELECT id, term, k, len(list_filter(title, lambda x: x = term)) AS tt, len(list_filter(body, lambda x: x = term)) AS tb, len(title) AS lt, len(body) AS lb,
  coalesce(list_position(list_concat(title, body), term), 0) AS place FROM p, t),
 f AS (SELECT term, count(*) FILTER (tt + tb > 0) AS df FROM o GROUP BY term),
 s AS (SELECT id, k, 10 * tt / (0.25 + 0.75 * lt / avt) + tb / (0.25 + 0.75 * lb / avb) AS x, CASE WHEN df = 0 THEN 0 ELSE ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5))) END AS idf, (1 << (place - 1)) AS mask, (lt + lb) / (avt + avb) AS share FROM o JOIN f USING (term), n WHERE tt + tb > 0),
 g AS (SELECT id, sum(idf * 2.2 * x / (1.2 + x)) AS base, count(*) AS m, bit_and(mask) AS common, any_value(share) AS share, max(CASE WHEN k = 0 THEN mask END) AS m0, max(CASE WHEN k = 1 THEN mask END) AS m1, max(CASE WHEN k = 2 THEN mask END) AS m2 FROM s GROUP BY id)
 SELECT id, round(base * CASE WHEN m > 1 THEN 1 + 0.5 * bit_count(common) / least(m, 32)::DOUBLE * exp(-0.1 * share) ELSE 1 END * CASE WHEN m = 3 AND ((m0 << 1) & m1) <> 0 AND ((m1 << 1) & m2) <> 0 THEN 1.5 ELSE 1 END, 6) AS score, m AS matched FROM g""")
def resorank(spark, d):
    """BM25F over fields, a global proximity multiplier and a boost where the terms' segments follow each other."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("title"), F.array(F.lower("p_type"), F.lower("p_brand")).alias("body"))
    fields = {"title": 10.0, "body": 1.0}
    return ranking.fielded(p, list(_TERMS), fields).withColumn("score", F.round("score", 6))


# ---- vectors
_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
_KNN = """q AS (SELECT vec_id AS query, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query, vec_id AS id, label, ql, list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS c FROM q JOIN embeddings ON query <> vec_id)"""


def _asked(spark, d):
    e = _t(spark, d, "embeddings")
    return e, e.filter("vec_id % 100 = 0")


@query(f"WITH {_KNN} SELECT query, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE label = ql AND label % 2 = 0 QUALIFY rank <= 5")
def vector_filtered_knn(spark, d):
    e, q = _asked(spark, d)
    found = vectors.nearest(e.filter("label % 2 = 0"), q, 5, within="label")
    return found.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KNN}, h AS (SELECT query, id, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE label <> ql QUALIFY rank <= 5) SELECT query, id, lang, source, round(c, 6) AS cosine FROM h JOIN documents ON doc_id = id")
def vector_hit_chunks(spark, d):
    """Hits of other labels, joined to their documents."""
    e, q = _asked(spark, d)
    pairs = q.select("vec_id", "embedding", F.col("label").alias("own")).withColumn("label", F.explode(F.array_except(F.lit(sorted(r[0] for r in e.select("label").distinct().collect())), F.array("own"))))
    hits = vectors.nearest(e, pairs, 5, within="label")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id"))).filter("rank <= 5")
    return best.join(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("query", "id", "lang", "source", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_KNN}, e AS (SELECT * FROM s JOIN documents a ON a.doc_id = s.query JOIN documents b ON b.doc_id = s.id WHERE a.lang = b.lang)
 SELECT query, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM e QUALIFY rank <= 5""")
def vector_scoped_neighbours(spark, d):
    """Neighbours among the vectors of documents of the query's language."""
    e = _t(spark, d, "embeddings").join(_t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    found = vectors.nearest(e, e.filter("vec_id % 100 = 0"), 5, within="lang")
    return found.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query()
def vector_mmr(spark, d):
    e, q = _asked(spark, d)
    top = vectors.nearest(e, q, 20).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    return vectors.rerank(top.select("query", "id", "cosine", "v", F.col("rank").alias("order")), 5, 0.7)


@query("SELECT len(embedding)::BIGINT AS dimension, count(*) AS n, round(avg(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS energy FROM embeddings GROUP BY 1")
def vector_dimension_router(spark, d):
    e = _t(spark, d, "embeddings")
    return e.groupBy(F.size("embedding").cast("long").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vectors.dot("embedding", "embedding")), 6).alias("energy"))


@query(f"WITH {_KNN} SELECT query, id, round(c, 6) AS cosine FROM s WHERE label = ql QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) <= 3")
def vector_index_restored(spark, d):
    """Search in an index that was written, partitioned by its filter column, and read again."""
    e = _t(spark, d, "embeddings")
    stored = Scratch(spark, "vector-index").table(e.repartition("label").sortWithinPartitions("label", "vec_id"), "index")
    return vectors.nearest(stored, stored.filter("vec_id % 100 = 0"), 3, within="label").select("query", "id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a='a.embedding', b='b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id % 100 = 0) SELECT a, b, round(c, 6) AS cosine FROM p WHERE round(c, 9) >= 0.2")
def pairwise_similarity(spark, d):
    e = _t(spark, d, "embeddings")
    a = e.filter("vec_id % 100 = 0").select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    p = a.join(b, "label").filter(F.col("a") < F.col("b")).select("a", "b", vectors.cosine("va", "vb").alias("cosine"))
    return p.filter(F.round("cosine", 9) >= 0.2).withColumn("cosine", F.round("cosine", 6))


_CENTRES = """x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL),
 c AS (SELECT label AS centre, list(v ORDER BY i) AS cv FROM m GROUP BY label)"""


def _centres(e):
    """The mean vector of each label."""
    x = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    c = x.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    return c.select(F.col("label").alias("centre"), F.transform("x", lambda s: s["v"]).alias("cv"))


@query(f"""WITH {_CENTRES}, d AS (SELECT vec_id, centre, round(list_distance(embedding::DOUBLE[], cv), 9) AS d FROM embeddings, c), n AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS d0 FROM d)
 SELECT vec_id, centre, round(d, 6) AS distance, d = d0 AS nearest FROM n WHERE d <= d0 * 1.02 OR (d0 < 0.001 AND d < 0.021)""")
def soft_assignment(spark, d):
    """Each vector's nearest centre and those hardly farther; centres are as many as labels."""
    e = _t(spark, d, "embeddings")
    centres = _centres(e).agg(F.collect_list(F.struct("centre", "cv")).alias("all"))
    x = e.crossJoin(F.broadcast(centres)).select("vec_id", "embedding", F.explode("all").alias("c")).select("vec_id", "embedding", "c.*")
    x = x.withColumn("d", F.round(F.sqrt(vectors.squared_distance("embedding", "cv")), 9)).withColumn("d0", F.min("d").over(Window.partitionBy("vec_id")))
    near = (F.col("d") <= F.col("d0") * 1.02) | ((F.col("d0") < 0.001) & (F.col("d") < 0.021))
    return x.filter(near).select("vec_id", "centre", F.round("d", 6).alias("distance"), (F.col("d") == F.col("d0")).alias("nearest"))


@query(f"""WITH {_CENTRES}, q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
 r AS (SELECT query, qv, centre, row_number() OVER (PARTITION BY query ORDER BY round({_COS.format(a='qv', b='cv')}, 9) DESC, centre) AS place FROM q, c QUALIFY place <= 2),
 s AS (SELECT query, vec_id AS id, centre, {_COS.format(a='qv', b='embedding')} AS c FROM r JOIN embeddings ON label = centre WHERE vec_id <> query)
 SELECT query, id, centre, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) <= 5""")
def summary_router_search(spark, d):
    """Two levels: the two inner nodes nearest to a query, then the best leaves below them, with their parent."""
    e, q = _asked(spark, d)
    nodes = _centres(e)
    routed = vectors.nearest(nodes.select(F.col("centre").cast("long").alias("vec_id"), F.col("cv").alias("embedding")), q.select((-1 - F.col("vec_id")).alias("vec_id"), "embedding"), 2)
    asked = q.join(routed.select((-1 - F.col("query")).alias("vec_id"), F.col("id").alias("node")), "vec_id").select("vec_id", "embedding", F.col("node").cast("int").alias("label"))
    hits = vectors.nearest(e, asked, 5, within="label").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("centre")), "id")
    best = hits.withColumn("p", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id"))).filter("p <= 5")
    return best.select("query", "id", "centre", F.round("cosine", 6).alias("cosine"))


_TANGENT = "list_transform(embedding::DOUBLE[], lambda x: x * 0.5 / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))"


@query(f"WITH b AS (SELECT vec_id, {_TANGENT} AS p FROM embeddings) SELECT vec_id, round(2 * atanh(sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) AS reach, round(0.5::DOUBLE, 6) AS back FROM b")
def tangent_round_trip(spark, d):
    """Points of the ball as tangent vectors at the origin and back."""
    b = _t(spark, d, "embeddings").select("vec_id", geometry.scaled("embedding", F.lit(0.5)).alias("p")).withColumn("t", geometry.log_origin("p")).withColumn("q", geometry.exp_origin("t"))
    return b.select("vec_id", F.round(vectors.magnitude("t"), 6).alias("reach"), F.round(vectors.magnitude("q"), 6).alias("back"))


# ---- hybrid
_LEX = _search_sql("double", ["license", "apache"])
_VEC = "v AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)"


def _lexical_and_vector(spark, d):
    lex = qgram.search(_t(spark, d, "documents"), "license apache", "double").select("doc_id", F.round("score", 6).alias("lex"))
    e = _t(spark, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("qv")).limit(1))
    return lex, e.crossJoin(one).select(F.col("vec_id").alias("doc_id"), vectors.cosine("embedding", "qv").alias("c"))


@query(f"WITH l AS ({_LEX}), {_VEC} SELECT doc_id, round(0.7 * least(score, 10) / 10 + 0.3 * coalesce(greatest(0, least(1, (c + 1) / 2)), 0), 6) AS score FROM l LEFT JOIN v USING (doc_id)")
def gdr_hybrid_hard(spark, d):
    """Hybrid search in which a lexical match is required."""
    lex, vec = _lexical_and_vector(spark, d)
    return lex.join(vec, "doc_id", "left").select("doc_id", F.round(ranking.blend(F.col("lex"), F.col("c")), 6).alias("score"))


@query(f"""WITH l AS ({_LEX}), {_VEC}, h AS (SELECT doc_id, 0.7 * least(score, 10) / 10 + 0.3 * coalesce(greatest(0, least(1, (c + 1) / 2)), 0) AS s FROM l LEFT JOIN v USING (doc_id)
 UNION ALL SELECT doc_id, 0.3 * greatest(0, least(1, (c + 1) / 2)) FROM v) SELECT doc_id, round(max(s), 6) AS score FROM h GROUP BY doc_id""")
def gdr_hybrid_soft(spark, d):
    """The hard results merged with ungated vector results by the higher score."""
    lex, vec = _lexical_and_vector(spark, d)
    hard = lex.join(vec, "doc_id", "left").select("doc_id", ranking.blend(F.col("lex"), F.col("c")).alias("score"))
    loose = vec.select("doc_id", ranking.blend(F.lit(None).cast("double"), F.col("c")).alias("score"))
    return ranking.merge_best("doc_id", "score", hard, loose).withColumn("score", F.round("score", 6))


@query(f"SELECT lang, count(*) AS n_scope, count(score) AS n_hits, round(count(score) / count(*)::DOUBLE, 6) AS rate FROM documents LEFT JOIN ({_LEX}) USING (doc_id) GROUP BY lang")
def gdr_counts(spark, d):
    lex, _ = _lexical_and_vector(spark, d)
    g = _t(spark, d, "documents").select("doc_id", "lang").join(lex, "doc_id", "left").groupBy("lang")
    return g.agg(F.count(F.lit(1)).alias("n_scope"), F.count("lex").alias("n_hits"), F.round(F.count("lex") / F.count(F.lit(1)), 6).alias("rate"))


@query(f"""WITH l AS (SELECT doc_id, source, score FROM ({_LEX}) JOIN documents USING (doc_id)), {_VEC}, s AS (SELECT source, max(score) AS best FROM l GROUP BY source ORDER BY best DESC, source LIMIT 5)
 SELECT doc_id, round(c, 6) AS cosine FROM v JOIN documents USING (doc_id) WHERE source IN (SELECT source FROM s) OR NOT EXISTS (SELECT 1 FROM s)""")
def shortlist_semantic(spark, d):
    """Semantic hits in the five best sources of a lexical search; in all of them if it finds none."""
    lex, vec = _lexical_and_vector(spark, d)
    docs = _t(spark, d, "documents").select("doc_id", "source")
    short = lex.join(docs, "doc_id").groupBy("source").agg(F.max("lex").alias("best")).orderBy(F.desc("best"), "source").limit(5)
    inside = vec.join(docs, "doc_id")
    found = inside if short.isEmpty() else inside.join(short, "source", "left_semi")
    return found.select("doc_id", F.round("c", 6).alias("cosine"))


# ---- graph-fused retrieval: chunks are orders, entities parts, the query names one part
_FUSED = """m AS (SELECT l_orderkey AS chunk, l_partkey AS entity FROM lineitem GROUP BY ALL), a AS (SELECT min(p_partkey) AS entity FROM part WHERE p_name = 'red widget'),
 h1 AS (SELECT DISTINCT y.entity FROM m x JOIN m y USING (chunk) JOIN a ON x.entity = a.entity WHERE y.entity <> a.entity), near AS (SELECT entity, 1.0::DOUBLE AS p FROM a UNION ALL SELECT entity, 0.5 FROM h1),
 g AS (SELECT chunk, max(p) AS graph FROM m JOIN near USING (entity) GROUP BY chunk), l AS (SELECT o_orderkey AS chunk, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS lex FROM orders WHERE o_orderpriority = '1-URGENT'),
 u AS (SELECT chunk, coalesce(lex, 0) AS lex, coalesce(graph, 0) AS graph FROM l FULL JOIN g USING (chunk)),
 f AS (SELECT chunk, graph, 0.6 * lex / max(lex) OVER () + 0.4 * graph / max(graph) OVER () AS score FROM u)"""


def _fused(spark, d):
    m = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")).distinct()
    anchor = _t(spark, d, "part").filter("p_name = 'red widget'").agg(F.min("p_partkey").alias("entity"))
    near = ranking.proximity(m, anchor, 0.5)
    lex = _t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("lex"))
    return m, near, ranking.fuse(lex, m.join(near, "entity").groupBy("chunk").agg(F.max("p").alias("graph")), 0.6, 0.4)


@query(f"WITH {_FUSED} SELECT chunk, round(score, 6) AS score FROM f")
def gldr_search(spark, d):
    return _fused(spark, d)[2].select("chunk", F.round("score", 6).alias("score"))


@query(f"""WITH {_FUSED}, e AS (SELECT entity, chunk, score, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, chunk) AS place FROM m JOIN f USING (chunk))
 SELECT e.entity, round(max(score) + 0.3 * coalesce(max(p), 0), 6) AS score, string_agg(chunk::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS first_chunks FROM e LEFT JOIN near USING (entity) GROUP BY e.entity""")
def gldr_nodes(spark, d):
    """Entities by their best chunk and their nearness, with their first three chunks."""
    m, near, fused = _fused(spark, d)
    e = m.join(fused, "chunk").withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("score", 9)), "chunk")))
    top = e.groupBy("entity").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "chunk")))).alias("c"))
    out = top.join(near, "entity", "left")
    return out.select("entity", F.round(F.col("best") + 0.3 * F.coalesce("p", F.lit(0.0)), 6).alias("score"), F.concat_ws(",", F.transform("c", lambda x: x["chunk"].cast("string"))).alias("first_chunks"))


@query("""WITH a AS (SELECT p_partkey AS id, count(l_orderkey) AS mentions FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_name = 'red widget' GROUP BY 1),
 t AS (SELECT id, 1 + 0.05 * ln(1 + mentions) AS score FROM a), b AS (SELECT p_partkey AS id, 0.25::DOUBLE AS score FROM part WHERE contains(p_name, 'red'))
 SELECT id, round(score, 6) AS score FROM t UNION ALL SELECT id, score FROM b WHERE NOT EXISTS (SELECT 1 FROM t)""")
def native_query(spark, d):
    """Exact alias hits by mentions; only without any, substring hits at a quarter."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    exact = part.filter("p_name = 'red widget'").join(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy("id").agg(F.count("one").alias("n"))
    if exact.isEmpty():
        return part.filter(F.contains("p_name", F.lit("red"))).select("id", F.lit(0.25).alias("score"))
    return exact.select("id", F.round(1 + 0.05 * F.log(1 + F.col("n")), 6).alias("score"))


@query("""WITH s AS (SELECT l_partkey AS e, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), k AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 25)
 SELECT e AS entity, n AS mentions FROM s WHERE e NOT IN (SELECT e FROM k) ORDER BY n DESC, e LIMIT 25""")
def lost_memory(spark, d):
    """Entities of messages that no observation holds, by mentions."""
    li = _t(spark, d, "lineitem")
    said = li.filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"))
    kept = li.filter("l_linestatus = 'F' AND l_quantity > 25").select(F.col("l_partkey").alias("entity"))
    return said.join(kept, "entity", "left_anti").orderBy(F.desc("mentions"), "entity").limit(25)
