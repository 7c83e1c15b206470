"""The automaton against a naive search of all surfaces, aliases, and pronouns against a plain rewrite."""

import random
import re

import pytest

from lodestone.functions import matching
from lodestone.operators import references

WORDS = ["New", "york", "York", "the", "St.", "o’neil", "O'Neil", "a–b", "É", "İx", "city", "of", "R&D", "日本"]
SEPS = [" ", "  ", ", ", "\n", " (", ") ", "; "]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice(SEPS) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def plain(text):
    """(canonical word, start, end) of each word."""
    fold = str.maketrans("’‘–—", "''--")
    return [(m[0].translate(fold).lower(), m.start(), m.end()) for m in re.finditer(r"(?:[^\W_]|['’‘\-–—·._/#&])+", text)]


def naive(text, surfaces):
    w = plain(text)
    out = []
    for s in surfaces:
        k = len(s.split(" "))
        out += [(s, i, w[i][1], w[i + k - 1][2]) for i in range(len(w) - k + 1) if " ".join(x[0] for x in w[i : i + k]) == s]
    return out


def longest(hits):
    kept, free = [], 0
    for h in sorted(hits, key=lambda h: (h[2], -h[3])):
        if h[2] >= free:
            kept.append(h)
            free = h[3]
    return kept


LEXICON = ["new york", "new york city", "york city", "york", "o'neil", "st. o'neil", "a-b of", "é", "r&d", "日本 日本", "city of the new"]


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("mode", ["all", "longest"])
def test_equals_the_naive_search(spark, monkeypatch, parts, mode):
    monkeypatch.setattr(matching, "PART_CHARS", 1 << 20 if parts == 1 else 25)
    rows = list(enumerate(texts(150)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([(s.upper() + " !", i) for i, s in enumerate(LEXICON)] + [("...!", None), ("?", 99)], "surface string, entity int")
    got = {(r.doc_id, r.surface, r.word, r.start, r.end) for r in matching.matches(docs, lexicon, mode).collect()}
    want = set()
    for i, t in rows:
        hits = naive(t, LEXICON)
        want |= {(i, *h) for h in (hits if mode == "all" else longest(hits))}
    assert got == want and len(got) > 100


def test_parts_of_words(spark):
    a = matching.Automaton(["ork", "york c", "rk"])
    assert a.find("New York City", inside=True) == [("york c", 1, 4, 10), ("ork", 1, 5, 8), ("rk", 1, 6, 8)]
    assert a.find("New York City") == [] and matching.Automaton([]).find("x") == []
    assert a.find("york c", "longest", inside=True) == [("york c", 0, 0, 6)]


def test_one_entity_for_a_surface(spark):
    lexicon = spark.createDataFrame([("The King", "b", 0), ("the  king", "a", 0), ("king", "z", 2), ("King", "a", 1), (None, "n", 1)], "surface string, entity string, priority int")
    assert {(r.surface, r.entity) for r in matching.chosen(lexicon).collect()} == {("the king", "a"), ("king", "z")}
    docs = spark.createDataFrame([(1, "the KING")], "doc_id long, text string")
    assert {(r.surface, r.entity) for r in matching.matches(docs, lexicon).collect()} == {("the king", "a"), ("king", "z")}
    assert matching.matches(docs, lexicon.limit(0)).count() == 0 == matching.matches(docs.limit(0), lexicon).count()
    with pytest.raises(ValueError):
        matching.matches(docs, lexicon, "first")


def test_aliases(spark):
    names = spark.createDataFrame([("Monkey D. Luffy", 1, "CHARACTER"), ("Straw Hat Pirates", 2, "faction"), ("Bo Li", 3, "CHARACTER"), ("Nami", 4, "CHARACTER"), ("World Trade Place", 5, "ORGANIZATION")], "surface string, entity int, kind string")
    got = {(r.surface, r.entity) for r in matching.aliases(names).collect() if not r.priority}
    assert got == {("luffy", 1), ("monkey luffy", 1), ("monkey", 1), ("shp", 2), ("straw hat", 2), ("wtp", 5)}


def test_pronouns_equal_a_plain_rewrite(spark):
    r = random.Random(7)
    names = {"Ann": "F", "Bob": "M", "Crew": "P", "Dog": "N", "Eve": None, "Fox": "U"}
    rows, want = [], set()
    for doc in range(40):
        recent = []
        for place in range(r.randrange(0, 30)):
            if r.random() < 0.5:
                e = r.choice(list(names))
                rows.append((doc, place, e, None))
                recent = [e, *(x for x in recent if x != e)][:3]
            else:
                p = r.choice("MFNP")
                rows.append((doc, place, None, p))
                hit = next((e for e in recent if (names[e] or "U") in (p, "U") or (p == "P" and names[e] == "N")), None)
                want.add((doc, place, p, hit))
    r.shuffle(rows)
    found = spark.createDataFrame(rows, "id long, place int, entity string, pronoun string").repartition(5)
    registry = spark.createDataFrame([(e, g) for e, g in names.items() if g], "entity string, gender string")
    got = references.resolve(found, registry, 3).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert references.resolve(found.limit(0), registry).count() == 0


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "Anna said they saw HER, Bo. It"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in references.mentions(docs).orderBy("place").collect()] == [(1, 0, "Anna", None), (1, 2, None, "P"), (1, 4, None, "F"), (1, 6, None, "N")]


def test_matches_bring_what_stands_in_the_text(spark):
    """The original text of a match comes with it, so texts need not be joined again; rows of one id stay apart."""
    docs = spark.createDataFrame([(1, "An OLD  King, and old king"), (1, "old–king"), (2, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("old king", 7)], "surface string, entity int")
    found = matching.matches(docs, lexicon, keep=True).collect()
    assert sorted(r["there"] for r in found) == ["OLD  King", "old king"]
    assert "there" not in matching.matches(docs, lexicon).columns
