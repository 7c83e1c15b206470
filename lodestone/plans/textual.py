"""Queries of segments, resolution, timelines, grouping sets and set algebra, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import segments
from lodestone.operators import resolution
from lodestone.plans.catalogue import _t, query

_S = """p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) - 1 AS place FROM documents),
s AS (SELECT doc_id, place, trim(s, ' ') AS sentence FROM p WHERE trim(s, ' ') <> '')"""
_W = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS place FROM documents)"""


def _words(spark, d):
    return segments.tokens(_t(spark, d, "documents"))


@query(f"WITH {_S} SELECT doc_id, place::BIGINT AS place, sentence FROM s")
def text_sentences(spark, d):
    return segments.sentences(_t(spark, d, "documents")).withColumn("place", F.col("at").cast("long")).drop("at")


@query(f"WITH {_S} SELECT doc_id, place::BIGINT AS place, length(sentence) AS n_chars, round(avg(length(sentence)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around FROM s")
def text_cadence(spark, d):
    return segments.cadence(segments.sentences(_t(spark, d, "documents"))).withColumn("around", F.round("around", 6)).withColumnRenamed("at", "place")


@query(f"""WITH {_W}, g AS (SELECT *, place - lag(place) OVER (PARTITION BY doc_id, word ORDER BY place) AS gap FROM w WHERE length(word) >= 4)
 SELECT doc_id, word, count(*) AS n_echoes, min(gap)::BIGINT AS nearest FROM g WHERE gap <= 26 GROUP BY ALL""")
def text_echoes(spark, d):
    return segments.echoes(_words(spark, d))


@query(f"""WITH {_W}, g AS (SELECT doc_id, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place))
 SELECT doc_id, gram, count(*) AS n_found FROM g WHERE gram IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def text_repeated_ngrams(spark, d):
    return segments.repeated_ngrams(_words(spark, d), 3)


@query(r"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '\[\[[^\]]+\]\]')), 0) AS n_links, coalesce(len(regexp_extract_all(text, '#[A-Za-z0-9_]+')), 0) AS n_tags,
 coalesce(len(regexp_extract_all(text, '@[A-Za-z0-9_]+')), 0) AS n_mentions FROM documents""")
def text_syntax_marks(spark, d):
    return _t(spark, d, "documents").select("doc_id", *segments.marks(F.col("text")))


@query("""WITH k AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) || '/' || p_brand || '/' || p_size AS key FROM part),
 h AS (SELECT key FROM k GROUP BY key HAVING count(*) >= 2), u AS (SELECT * FROM k SEMI JOIN h USING (key))
 SELECT a.id AS left_id, b.id AS right_id, count(*) AS n_keys FROM u a JOIN u b ON a.key = b.key AND a.id < b.id GROUP BY ALL""")
def entity_block_pairs(spark, d):
    p = _t(spark, d, "part")
    keys = p.select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.explode(F.split("p_name", " ")).alias("w"))
    keys = keys.select("id", F.concat_ws("/", "w", "p_brand", F.col("p_size").cast("string")).alias("key"))
    return resolution.block_pairs(p.select(F.col("p_partkey").alias("id")), keys)


@query("""SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN lag(event_id) OVER w END AS cause
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def causal_links(spark, d):
    return resolution.causal_links(_t(spark, d, "events"), "user_id", "ts", "event_id", F.lit(3600)).select("event_id", "cause")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS axis, count(*) AS n_events, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at FROM events GROUP BY ALL")
def timeline_segments(spark, d):
    e = _t(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return resolution.timeline(e, "user_id", F.date_format("ts", "yyyy-MM-dd"), "us")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, grouping(l_returnflag)::BIGINT * 2 + grouping(l_linestatus)::BIGINT AS level
 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouping_cube(spark, d):
    cube = _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT event_type, count(*) AS n, round(stddev_pop(value), 6) AS spread, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def value_spread(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.stddev_pop(v), 6).alias("spread"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.9), 6).alias("p90")
    )


@query("""SELECT user_id, 'both' AS part FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')
 UNION ALL SELECT user_id, 'click only' FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')""")
def set_algebra(spark, d):
    e = _t(spark, d, "events")
    a, b = (e.filter(F.col("event_type") == k).select("user_id") for k in ("click", "purchase"))
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.subtract(b).withColumn("part", F.lit("click only")))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place, count(*) AS support FROM events GROUP BY user_id, event_type)
 SELECT user_id, event_type AS winner, support FROM r WHERE place = 1""")
def slot_winner(spark, d):
    support = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("support"))
    best = Window.partitionBy("user_id").orderBy(F.desc("support"), "event_type")
    return support.withColumn("place", F.row_number().over(best)).filter("place = 1").select("user_id", F.col("event_type").alias("winner"), "support")
