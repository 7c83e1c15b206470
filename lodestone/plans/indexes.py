"""Queries of stored indexes, matchers and resolvers, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.functions import dictionary, matching
from lodestone.operators import inverted, references, semantic, summary_tree, vector_index
from lodestone.plans.catalogue import _t, query
from lodestone.plans.search import _QUERY, _search_sql

# ---- the inverted index of q-grams, written and read again
def _index(spark, d) -> inverted.Index:
    path = Scratch(spark, "qgrams").root
    inverted.build(_t(spark, d, "documents"), path)
    return inverted.load(spark, path)


@query(_search_sql("plain"))
def qgram_index_search(spark, d):
    hits = inverted.search(spark, _index(spark, d), _QUERY)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


@query("SELECT * FROM (" + _search_sql("plain") + ") ORDER BY score DESC, doc_id LIMIT 10")
def qgram_index_top(spark, d):
    """The ten best hits; blocks that cannot hold one of them are not read."""
    best, _ = inverted.Search(spark, _index(spark, d), _QUERY).best(10)
    return best.select(F.col("id").alias("doc_id"), "score", "matched")


@query("""WITH g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i::BIGINT, 3))) AS gram FROM documents)
 SELECT gram, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM g GROUP BY gram""")
def qgram_index_postings(spark, d):
    """The documents and places of every gram in the index."""
    rows = _index(spark, d).postings(spark).filter(~F.contains("gram", F.lit("\0")))
    return rows.groupBy("gram").agg(F.sum("n").alias("documents"), F.sum("occurrences").alias("occurrences"))


# ---- the vector index: cells, codes, rerank
_KNN10 = """SELECT query, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank
 FROM (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.v::DOUBLE[], e.v::DOUBLE[]) AS c FROM {t} q JOIN {t} e ON q.vec_id <> e.vec_id{on} WHERE q.vec_id % 100 = 0) QUALIFY rank <= {k}"""


def _found(hits):
    return hits.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query()
def vector_index_search(spark, d):
    """The ten nearest by as many cells as find 95 % of the neighbours of a sample."""
    e = _t(spark, d, "embeddings")
    index = vector_index.tune(vector_index.build(e, Scratch(spark, "vectors").root), spark)
    return _found(vector_index.search(index, e.filter("vec_id % 100 = 0"), 10))


@query("WITH t AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 11 <> 3) " + _KNN10.format(t="t", on="", k=10))
def vector_index_updated(spark, d):
    """An index of six sevenths of the rows, read again, with the rest added and every eleventh row deleted; all cells are asked."""
    e, root = _t(spark, d, "embeddings"), Scratch(spark, "vectors").root
    vector_index.build(e.filter("vec_id % 7 <> 0"), root)
    index = vector_index.load(spark, root)
    vector_index.upsert(index, e.filter("vec_id % 7 = 0"))
    vector_index.delete(index, e.filter("vec_id % 11 = 3"))
    return _found(vector_index.search(index, e.filter("vec_id % 100 = 0 AND vec_id % 11 <> 3"), 10, probes=len(index.centres)))


@query("WITH t AS (SELECT vec_id, embedding[1:CASE WHEN label % 2 = 0 THEN 64 ELSE 32 END] AS v FROM embeddings) " + _KNN10.format(t="t", on=" AND len(q.v) = len(e.v)", k=5))
def vector_routed_by_dimension(spark, d):
    """One index for each length of vectors; a query asks that of its own length."""
    e = _t(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), F.when(F.col("label") % 2 == 0, F.lit(64)).otherwise(F.lit(32))).alias("embedding"))
    out = None
    for n, index in vector_index.by_dimension(e, Scratch(spark, "vectors").root).items():
        hits = vector_index.search(index, e.filter((F.col("vec_id") % 100 == 0) & (F.size("embedding") == n)), 5, probes=len(index.centres))
        out = hits if out is None else out.unionByName(hits)
    return _found(out)


# ---- trees of summaries over the documents of each language
def _tree(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    leaves = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text").join(e, "id")
    return summary_tree.build(leaves)


@query()
def summary_tree_edges(spark, d):
    """Every leaf and inner node with its parent, and the size of the parent's summary."""
    tree = _tree(spark, d)
    parents = tree.nodes.select("grp", F.col("node").alias("parent"), "level", F.length("text").alias("summary"))
    return tree.edges.join(parents, ["grp", "parent"]).select("grp", "child", "parent", "level", "summary")


@query()
def summary_tree_search(spark, d):
    """The five best leaves below the inner nodes that a query is near to, with the parents that they stand under."""
    asked = _t(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    hits = summary_tree.search(_tree(spark, d), asked, 5)
    return hits.select("query", "grp", "node", F.round("cosine", 6).alias("cosine"), "parents", F.col("rank").cast("long").alias("rank"))


# ---- known surfaces: the first two and three words of every benchmark item, in all documents
_CANON = r"trim(regexp_replace(translate(lower({}), '’‘–—', '''''--'), '[^\p{{L}}\p{{Nd}}''\-·._/#&]+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT item_id, string_split({_CANON.format('text')}, ' ') AS w FROM benchmark),
 x AS (SELECT surface, min(item_id) AS entity FROM (SELECT item_id, array_to_string(w[1:k], ' ') AS surface FROM b, (SELECT unnest([2, 3]) AS k) WHERE len(w) >= k) GROUP BY surface),
 t AS (SELECT doc_id, string_split({_CANON.format('text')}, ' ') AS w FROM documents),
 g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM t, (SELECT unnest([2, 3]) AS k) WHERE len(w) >= k)
 SELECT doc_id, (i - 1)::INTEGER AS word, surface, entity, true AS same FROM (SELECT doc_id, i, array_to_string(w[i:i + k - 1], ' ') AS surface FROM g) JOIN x USING (surface)""")
def dictionary_matches(spark, d):
    """Every place of a known surface, overlapping ones too; ``same`` says that the original text there has the surface's form."""
    words = F.split(matching.canonical(F.col("text")), " ")
    surfaces = F.array(*[F.when(F.size(words) >= k, F.array_join(F.slice(words, 1, k), " ")) for k in (2, 3)])
    lexicon = _t(spark, d, "benchmark").select(F.explode(surfaces).alias("surface"), F.col("item_id").alias("entity")).filter("surface IS NOT NULL")
    docs = _t(spark, d, "documents").select("doc_id", "text")
    found = matching.matches(docs, lexicon, keep=True)
    there = matching.canonical(F.col("there"))
    return found.select("doc_id", "word", "surface", "entity", (there == F.col("surface")).alias("same"))


# ---- pronouns: names are capitalised words, their gender (as a registry would hold it) goes by their length
_GENDER = "CASE length(entity) % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'N' WHEN 3 THEN 'P' ELSE 'U' END"


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS place FROM documents),
 k AS (SELECT doc_id, place, word, CASE WHEN lower(word) IN ('he', 'him', 'his') THEN 'M' WHEN lower(word) IN ('she', 'her', 'hers') THEN 'F' WHEN lower(word) IN ('it', 'its') THEN 'N' WHEN lower(word) IN ('they', 'them', 'their') THEN 'P' END AS pronoun FROM w),
 m AS (SELECT doc_id, place, word AS entity FROM k WHERE pronoun IS NULL AND regexp_full_match(word, '[A-Z][a-z]{{3,}}')), p AS (SELECT doc_id, place, pronoun FROM k WHERE pronoun IS NOT NULL),
 l AS (SELECT p.doc_id, p.place, p.pronoun, m.entity, max(m.place) AS last FROM p JOIN m ON m.doc_id = p.doc_id AND m.place < p.place GROUP BY ALL),
 h AS (SELECT *, {_GENDER} AS gender, row_number() OVER (PARTITION BY doc_id, place ORDER BY last DESC) AS back FROM l),
 r AS (SELECT doc_id, place, arg_max(entity, last) AS entity FROM h WHERE back <= 10 AND (gender IN (pronoun, 'U') OR (pronoun = 'P' AND gender = 'N')) GROUP BY ALL)
 SELECT p.doc_id, p.place::INTEGER AS place, p.pronoun, r.entity FROM p LEFT JOIN r USING (doc_id, place)""")
def pronoun_resolution(spark, d):
    """What every pronoun stands for: the most recent of the last ten entities whose gender goes with it."""
    found = references.mentions(_t(spark, d, "documents"))
    registry = found.select("entity").distinct().filter("entity IS NOT NULL").select("entity", F.expr(_GENDER).alias("gender"))
    return references.resolve(found, registry).withColumnRenamed("id", "doc_id")


# ---- a stored dictionary of all words of the documents, and the words of the benchmark looked up in it
_WORDS = "SELECT w AS term, count(*) AS value FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM {}) GROUP BY w"


def _words(spark, d, table):
    return _t(spark, d, table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("term"), F.lit(1).alias("value"))


@query(f"""WITH t AS ({_WORDS.format('documents')}), q AS (SELECT term AS query FROM ({_WORDS.format('benchmark')})),
 p AS (SELECT query, term, value, levenshtein(query, term) AS distance FROM q, t WHERE abs(length(query) - length(term)) <= 1)
 SELECT query, term, value, distance FROM p WHERE distance <= 1""")
def dictionary_fuzzy(spark, d):
    """The words of the documents within one edit of a word of the benchmark, with their counts."""
    path = Scratch(spark, "dictionary").root
    dictionary.build(_words(spark, d, "documents"), path)
    found = dictionary.fuzzy(spark.read.parquet(path), _words(spark, d, "benchmark").select(F.col("term").alias("query")), 1)
    return found.withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH t AS ({_WORDS.format('documents')}) SELECT 'prefix' AS lookup, count(*) AS n, sum(value)::BIGINT AS value FROM t WHERE starts_with(term, 'that')
 UNION ALL SELECT 'range', count(*), sum(value)::BIGINT FROM t WHERE term >= 'and' AND term < 'bl' UNION ALL SELECT 'exact', count(*), sum(value)::BIGINT FROM t WHERE term = (SELECT min(term) FROM t)""")
def dictionary_scans(spark, d):
    """A prefix scan, a range scan and an exact lookup (of the least term) in the stored dictionary."""
    path = Scratch(spark, "dictionary").root
    dictionary.build(_words(spark, d, "documents"), path)
    least = dictionary.ends(spark, path).first()["least"] or ""
    scans = {"prefix": dictionary.prefix(spark, path, "that"), "range": dictionary.between(spark, path, "and", "bl"), "exact": dictionary.exact(spark, path, least)}
    out = None
    for name, rows in scans.items():
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.lit(name).alias("lookup"), "n", "value")
        out = one if out is None else out.unionByName(one)
    return out


# ---- semantic candidate edges: families are labels of vectors, planes languages, polarities the quality of a document
@query("""WITH n AS (SELECT vec_id AS id, label::VARCHAR AS family, lang AS plane, quality AS polarity, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN labels l ON l.doc_id = vec_id),
 s AS (SELECT x.id AS q, y.id AS i, list_cosine_similarity(x.v, y.v) AS c FROM n x JOIN n y ON x.family = y.family AND x.id <> y.id),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, i) AS rank FROM s), m AS (SELECT p.q AS a, p.i AS b, p.c FROM k p JOIN k r ON r.q = p.i AND r.i = p.q WHERE p.rank <= 10 AND r.rank <= 10 AND p.q < p.i AND round(p.c, 9) >= 0.2)
 SELECT a, b, x.family, round(c, 6) AS cosine, CASE WHEN x.polarity <> y.polarity THEN 'contradicts' ELSE 'supports' END AS kind FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.plane = y.plane""")
def semantic_edges(spark, d):
    """Mutual neighbours of one family and plane, and whether they contradict each other; all cells are asked."""
    quality = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("polarity"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("plane"))
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("family"), F.col("embedding").alias("v"))
    edges = semantic.candidate_edges(e.join(docs, "id").join(quality, "id", "left"), Scratch(spark, "semantic").root, 10, 0.2, vector_index.MOST_CELLS)
    return edges.withColumn("cosine", F.round("cosine", 6))
