"""Queries of chunks, chapters, surfaces and entity discovery, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunks
from lodestone.plans.catalogue import _t, query


@query()
def text_chunks(spark, d):
    return chunks.chunked(_t(spark, d, "documents"))


@query()
def semantic_chunks(spark, d):
    """Chunks that end where the topic changes, at a line end past the least size, or at the most."""
    return chunks.semantic_chunked(_t(spark, d, "documents"))


@query()
def chunks_of_scope(spark, d):
    """The leaf chunks of the documents of one language and folder."""
    docs = _t(spark, d, "documents").filter((F.col("lang") == "en") & F.col("source").startswith("src1"))
    return chunks.chunked(docs).filter("level = 0").select("doc_id", "place", "start", "end")


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Chapter ' || turn || chr(10) || text ELSE turn || '.1 notes' || chr(10) || text END AS text FROM conversations))
 SELECT conv_id * 1000 + turn AS doc_id, line::INTEGER AS line, title, (lead(line) OVER (PARTITION BY conv_id, turn ORDER BY line))::INTEGER AS until FROM l WHERE regexp_matches(lower(title), '^(chapter|part|book|prologue|epilogue|section) ') OR regexp_matches(title, '^[0-9]+(\.[0-9]+)*\.? ')""")
def text_chapters(spark, d):
    """Chapter openings; every other turn gets a heading so that both kinds occur."""
    turn = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Chapter "), turn, F.lit("\n"), "text")).otherwise(F.concat(turn, F.lit(".1 notes\n"), "text"))
    return chunks.chapters(_t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text")))


@query("""WITH t AS (SELECT p_partkey AS doc_id, string_split(lower(p_name || ' ' || p_type), ' ') AS t FROM part), g AS (SELECT doc_id, unnest(t) AS surface FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t),
 x AS (SELECT DISTINCT lower(p_name) AS surface, 'name' AS entity FROM part UNION ALL SELECT DISTINCT lower(p_type), 'type' FROM part) SELECT doc_id, entity, count(*) AS n FROM g JOIN x USING (surface) GROUP BY ALL""")
def lexicon_scan(spark, d):
    p = _t(spark, d, "part")
    lexicon = p.select(F.lower("p_name").alias("surface"), F.lit("name").alias("entity")).union(p.select(F.lower("p_type"), F.lit("type"))).distinct()
    return chunks.surfaces(p.withColumnRenamed("p_partkey", "doc_id"), lexicon, 2, F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS token FROM documents), c AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY token)
 SELECT token, n, docs, CASE WHEN ends_with(token, 'er') THEN 'person' WHEN ends_with(token, 'tion') THEN 'concept' ELSE 'unknown' END AS kind FROM c WHERE docs >= 3 AND lower(token) NOT IN ('that', 'this', 'with', 'from')""")
def entity_discovery(spark, d):
    """Capitalised words of three documents and more that are no stop words, with a kind by their ending."""
    w = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("token"))
    c = w.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("docs >= 3")
    kind = F.when(F.col("token").endswith("er"), "person").when(F.col("token").endswith("tion"), "concept").otherwise("unknown")
    return c.filter(~F.lower("token").isin("that", "this", "with", "from")).select("token", "n", "docs", kind.alias("kind"))


_ALIAS = [r"also known as (\w+)", r"aka (\w+)", r"\((\w+)\)", r" or (\w+)", r"real name (\w+)", r"otherwise known as (\w+)", r" - (\w+)"]


@query("WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name || ' also known as ' || c_mktsegment WHEN 1 THEN c_name || ' (' || c_mktsegment || ')' WHEN 2 THEN c_name || ' - ' || c_mktsegment ELSE c_name END AS s FROM customer), a AS (" + " UNION ALL ".join(f"SELECT id, {k} AS pattern, unnest(regexp_extract_all(s, '{p}', 1)) AS alias FROM t" for k, p in enumerate(_ALIAS)) + ") SELECT id, pattern, alias FROM a")
def alias_patterns(spark, d):
    """Aliases that a text states, by pattern."""
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    text = F.when(k == 0, F.concat("c_name", F.lit(" also known as "), s)).when(k == 1, F.concat("c_name", F.lit(" ("), s, F.lit(")"))).when(k == 2, F.concat("c_name", F.lit(" - "), s)).otherwise(F.col("c_name"))
    t = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("s"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("s", F.lit(p), F.lit(1)), _tagged(i)) for i, p in enumerate(_ALIAS)]))
    return t.select("id", F.explode(found).alias("x")).select("id", "x.pattern", "x.alias")


def _tagged(i: int):
    return lambda a: F.struct(F.lit(i).alias("pattern"), a.alias("alias"))
