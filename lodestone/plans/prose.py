"""Queries of phrases, narrated events and readability, with DuckDB twins."""

from __future__ import annotations

from lodestone.functions import phrases
from lodestone.plans.catalogue import _t, query


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _sql_base() -> str:
    known = " ".join(f"WHEN lower(w) IN ({_quoted(phrases.KNOWN[k].split())}) THEN '{k}'" for k in ["N", *[k for k in phrases.KNOWN if k != "N"]])
    ends = " ".join(f"WHEN regexp_matches(lower(w), '({e.replace(' ', '|')})$') THEN '{k}'" for k, e in phrases.ENDINGS.items())
    return rf"CASE {known} WHEN regexp_full_match(w, '\p{{P}}|-|''') THEN 'S' WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'N' {ends} ELSE 'N' END"


_TOKEN = phrases.TOKEN.replace("'", "''")
_PHRASES = rf"""t AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), b AS (SELECT *, {_sql_base()} AS b FROM w),
c AS (SELECT *, lag(b) OVER o AS p, lag(b, 2) OVER o AS q FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, w, CASE WHEN p IN ('D', 'J', 'R', 'F') AND b IN ('V', 'X', 'M') THEN 'N' WHEN b = 'N' AND (p = 'T' OR (p = 'M' AND coalesce(q, '-') NOT IN ('D', 'J', 'R', 'F'))) THEN 'V' ELSE b END AS tag FROM c),
s AS (SELECT doc_id, string_agg(translate(tag, '{phrases.CLASSES}', '{phrases.MARKS}') || w, '' ORDER BY i) AS s FROM g GROUP BY doc_id),
x AS (SELECT doc_id, regexp_extract_all(s, '{phrases.PHRASE}') AS x FROM s),
y AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS place FROM x),
y2 AS (SELECT *, translate(piece[1], '{phrases.MARKS}', '{phrases.CLASSES}') AS c FROM y),
z AS (SELECT *, CASE WHEN c IN ('P', 'T', 'F') THEN 'prep' WHEN c = 'Q' THEN 'clause' WHEN c IN ('D', 'J', 'N') THEN 'noun' ELSE 'verb' END AS kind,
 regexp_extract(piece, '{phrases.LAST}', 1) AS last, regexp_extract(piece, '{phrases.VERB}', 1) AS verb FROM y2),
f AS (SELECT doc_id, place::INTEGER AS place, kind, CASE WHEN kind = 'prep' THEN regexp_extract(piece, '{phrases.FIRST}', 1) WHEN kind = 'noun' THEN last WHEN verb <> '' THEN verb
 WHEN kind = 'clause' THEN regexp_extract(piece, '{phrases.LONE}', 1) ELSE last END AS head,
 ltrim(regexp_replace(piece, '[{phrases.MARKS}]', ' ', 'g')) AS phrase FROM z)"""


@query(f"WITH {_PHRASES} SELECT doc_id, place, kind, head, phrase FROM f")
def text_phrases(spark, d):
    """Noun, verb and prepositional phrases and relative clauses of every document."""
    return phrases.phrases(_t(spark, d, "documents"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(lower(head), '{e}') AND length(head) > {len(e) + 2} THEN lower(head)[:-{len(e) + 1}]" for e in phrases.VERB_ENDINGS) + " ELSE lower(head) END"
_VERBS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in phrases.verb_rows())


@query(
    f"""WITH {_PHRASES}, n AS (SELECT *, last_value(CASE WHEN kind = 'noun' THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS subject,
 first_value(CASE WHEN kind = 'noun' THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS object FROM f),
 v(stem, event, relation) AS (VALUES {_VERBS}), k AS (SELECT *, {_STEM} AS stem FROM n WHERE kind = 'verb')
 SELECT doc_id, place, event, relation, coalesce(subject, 'Unknown') AS subject, coalesce(object, 'Unknown') AS object FROM k JOIN v USING (stem)"""
)
def narrative_events(spark, d):
    """Who does what to whom, by a dictionary of verbs."""
    return phrases.narrated(_t(spark, d, "documents"))


_WORD = r"[A-Za-z0-9_''\-]+"
_SYL = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(lower(w), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END"
_BUCKETS = ["x <= 1", "x BETWEEN 2 AND 6", "x BETWEEN 7 AND 15", "x BETWEEN 16 AND 25", "x BETWEEN 26 AND 39", "x >= 40"]


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws, list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(translate(s, chr(10) || chr(9) || chr(13), '   ')) <> ''), lambda s: len(regexp_extract_all(s, '{_WORD}'))) AS l FROM documents),
 b AS (SELECT doc_id, len(ws)::BIGINT AS words, coalesce(list_sum(list_transform(ws, lambda w: {_SYL})), 0)::BIGINT AS syllables, len(l)::BIGINT AS sentences, coalesce(list_sum(l), 0)::BIGINT AS s1, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)::BIGINT AS s2,
 {", ".join(f"len(list_filter(l, lambda x: {c})) AS b{k}" for k, c in enumerate(_BUCKETS))} FROM a),
 c AS (SELECT *, {" + ".join(f"(b{k} > 0)::INT" for k in range(6))} AS used, {" + ".join(f"CASE WHEN b{k} > 0 THEN -(b{k}::DOUBLE / sentences) * log2(b{k}::DOUBLE / sentences) ELSE 0 END" for k in range(6))} AS entropy,
 CASE WHEN sentences > 0 THEN sqrt((sentences * s2 - s1 * s1)::DOUBLE) / sentences ELSE 0 END AS dev FROM b),
 e AS (SELECT *, (CASE WHEN used > 1 THEN floor(100 * entropy / log2(used::DOUBLE) + 0.5::DOUBLE) ELSE 0 END)::BIGINT AS variety, CASE WHEN words > 0 AND sentences > 0 THEN 0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE END AS grade FROM c)
 SELECT doc_id, words, sentences, syllables, CASE WHEN sentences > 0 THEN floor(words * 10 / sentences::DOUBLE + 0.5::DOUBLE) / 10 ELSE 0.0 END::DOUBLE AS mean_length, round(dev, 6)::DOUBLE AS deviation, variety,
 (CASE WHEN sentences > 0 THEN floor(least(100.0::DOUBLE, dev / 8 * 100) * 0.6::DOUBLE + variety * 0.4::DOUBLE + 0.5::DOUBLE) ELSE 0 END)::BIGINT AS flow,
 CASE WHEN grade IS NULL THEN 'N/A' WHEN grade < 1 THEN 'Kindergarten' WHEN grade < 6 THEN '1st-5th Grade' WHEN grade < 9 THEN '6th-8th Grade' WHEN grade < 13 THEN '9th-12th Grade' WHEN grade < 17 THEN 'College Level' ELSE 'Graduate Level' END AS level,
 ceil(words * 60 / 150.0::DOUBLE)::BIGINT AS speaking_seconds FROM e"""
)
def text_readability(spark, d):
    """Syllables, sentence lengths and their spread, and the grade that a text asks for."""
    return phrases.readability(_t(spark, d, "documents"))
