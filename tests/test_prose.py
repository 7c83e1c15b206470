"""Phrases, events and readability on sentences of known parse, on odd rows, and against their SQL twins."""

import glob
import os

import duckdb
import pytest

from lodestone.functions import phrases
from lodestone.plans import catalogue, prose

WHERE = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == prose.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{WHERE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = catalogue.QUERIES[name](spark, WHERE)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert len(rows) == len(want) > 0
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_sentences(spark):
    text = "The old wizard quickly killed a dragon. He can attack the tower, and the attack of killing went in the dark forest."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "- ' !"), (5, "The knight who slowly is wise.")], "doc_id long, text string")
    found = phrases.phrases(docs)
    got = [(r.doc_id, r.kind, r.phrase, r.head) for r in found.orderBy("doc_id", "place").collect()]
    assert got[:3] == [(1, "noun", "The old wizard", "wizard"), (1, "verb", "quickly", "quickly"), (1, "noun", "killed", "killed")]
    assert (1, "noun", "the attack", "attack") in got  # a verb after a determiner is a noun
    assert (1, "prep", "of killing", "of") in got
    assert (1, "verb", "can attack", "attack") in got
    assert (1, "prep", "in the dark forest", "in") in got
    assert [g for g in got if g[0] in (2, 3, 4)] == []
    assert (5, "clause", "who slowly is", "slowly") in got
    seen = [(r.event, r.relation, r.subject, r.object) for r in phrases.events(found).filter("doc_id = 1").orderBy("place").collect()]
    assert seen == [("BATTLE", "ATTACKS", "He", "tower")]


def test_readability_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "Make a cake. Yes."), (2, None), (3, "..."), (4, "ß ß. ß")], "doc_id long, text string")
    r = {x.doc_id: x for x in phrases.readability(docs).collect()}
    assert (r[1].words, r[1].sentences, r[1].syllables, r[1].mean_length) == (4, 2, 4, 2.0)
    assert r[1].level == "Kindergarten" and r[1].variety == 100 and r[1].deviation == 1.0
    assert (r[2].words, r[2].level, r[3].sentences, r[4].sentences, r[4].words) == (0, "N/A", 0, 2, 0)


def test_very_long_runs(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, "stone " * n), (2, "slowly " * n + "killed"), (3, "who " + "slowly " * n)], "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.head, len(r.phrase.split())) for r in phrases.phrases(docs).filter("place = 0").collect()}
    assert got == {1: ("noun", "stone", n), 2: ("verb", "slowly", n), 3: ("clause", "slowly", n + 1)}


def test_words_are_classed_once_and_phrases_cross_in_one_string(spark):
    """No array function runs over the tokens of a text; both patterns for tokens agree on ASCII."""
    tagger = phrases.Tagger()
    text = "".join(map(chr, range(32, 127))) + " The old king will ring the bell, and to king of ruled men."
    assert phrases._PLAIN_TOKENS.findall(text) == phrases._TOKENS.findall(text)
    assert [phrases.CLASSES[phrases.MARKS.index(c)] for c in tagger.tagged("to king of ruled can ring") if c in phrases.MARKS] == list("TVFNMV")
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "The old king")], "doc_id long, text string")
    found = phrases.phrases(rows)
    assert [tuple(r) for r in found.collect()] == [(4, 0, "noun", "king", "The old king")]
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_found_within_a_row(spark):
    """The same events as from rows of phrases, without a shuffle or a window."""
    texts = ["Tom saw Ann. She quickly killed a dragon and told", "attacked fought the King who slowly is wise; the men found gold", None, "", "slowly", "İt was. ﬁnd K."]
    texts += [r.text for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("text").limit(40).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = phrases.narrated(docs)
    want = phrases.events(phrases.phrases(docs)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = prose.narrative_events(spark, WHERE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
