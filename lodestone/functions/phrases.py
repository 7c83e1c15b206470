"""Word classes, phrases, narrated events and readability of prose, within each document's row.

A token is written as the mark of its class (a private character) and its text; phrases
are then matches of one pattern over that string, so tagging and chunking need no
shuffle.  A run of one class is a single character set in the pattern, so texts of any
length are matched without recursion.
Classes: D determiner, T "to", F "of", P other preposition, X auxiliary, M modal,
C conjunction, Q relative pronoun, J adjective, R adverb, V verb, N noun, name or
pronoun, S punctuation.

Defined results: null and empty texts have no phrases and no events; repeated rows
of one id are one document each in ``phrases`` and ``narrated``, in ``events`` only if the id is unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = "DPTFXMCQJRVNS"
MARKS = "".join(chr(0xE000 + k) for k in range(len(CLASSES)))
END = chr(0xE000 + len(CLASSES))  # no token holds a private character
TOKEN = r"[\p{L}\p{Nd}'\-]+|\p{P}"

# Word classes of known words.  A word of two classes has the last one.
KNOWN = {
    "D": "the a an this these those my your his her its our their some any no every each all both few many much most other",
    "P": "in on at for with by from about into through during before after above below between under over against among around behind beside beyond near toward towards upon within without across along inside outside throughout",
    "T": "to",
    "F": "of",
    "X": "is are was were be been being am have has had having do does did doing",
    "M": "can could will would shall should may might must",
    "C": "and or but nor yet so because although while if unless until since when where whether",
    "Q": "who whom whose which that",
    "J": "old new good bad great small large big little young long short high low early late first last ancient dark bright powerful mighty wise evil grey black white red blue green golden silver",
    "R": "very quite rather really too just only now then here there always never often sometimes slowly quickly suddenly finally already still even",
    "V": "go went gone going come came coming say said saying see saw seen seeing know knew known knowing take took taken taking get got getting make made making walk walked walking run ran running live lived living speak spoke spoken speaking fight fought fighting kill killed killing love loved loving hate hated hating rule ruled ruling serve served serving attack",
    "N": "king ring",
}
# Classes by ending, tried in this order; words in capitals and all others are N.
ENDINGS = {"R": "ly", "V": "ing ed en", "N": "ness tion ment ity er or", "J": "ful less ous ive able ible"}

# Stem, event and relation of narrated verbs.
VERBS = """
attack BATTLE ATTACKS, battl BATTLE FIGHTS, defeat BATTLE DEFEATS, duel DUEL FIGHTS, fight BATTLE FIGHTS, fought BATTLE FIGHTS,
kill DEATH KILLS, slay DEATH KILLS, wound BATTLE ATTACKS,
approach TRAVEL ARRIVES, arriv TRAVEL ARRIVES, depart TRAVEL DEPARTS, enter TRAVEL ARRIVES, exit TRAVEL DEPARTS, journey TRAVEL TRAVELS,
leav TRAVEL DEPARTS, sail TRAVEL TRAVELS, travel TRAVEL TRAVELS, visit TRAVEL ARRIVES,
conceal CONCEALS CONCEALS, discov DISCOVERY DISCOVERS, find DISCOVERY FINDS, hid CONCEALS CONCEALS, learn DISCOVERY DISCOVERS,
li DECEIVES DECEIVES, reveal REVEALS REVEALS, uncover DISCOVERY DISCOVERS,
are STATE IS, be STATE IS, becam TRANSFORM BECOMES, became TRANSFORM BECOMES, become TRANSFORM BECOMES, been STATE IS, is STATE IS,
transform TRANSFORM BECOMES, turn TRANSFORM BECOMES, was STATE IS, were STATE IS,
hear DISCOVERY OBSERVES, heard DISCOVERY OBSERVES, look DISCOVERY OBSERVES, notic DISCOVERY OBSERVES, observ DISCOVERY OBSERVES,
saw DISCOVERY OBSERVES, see DISCOVERY OBSERVES, watch DISCOVERY OBSERVES, witness DISCOVERY OBSERVES,
give ACQUIRE GIVES, own ACQUIRE OWNS, steal THEFT STEALS, take ACQUIRE TAKES,
caus CAUSE CAUSES, enabl CAUSE ENABLES, prevent PREVENT PREVENTS,
accus ACCUSATION ACCUSES, ask DIALOGUE SPEAKS_TO, bargain BARGAIN INTERACTS, call DIALOGUE SPEAKS_TO, claim DIALOGUE SPEAKS_TO,
command DIALOGUE RULES, crie DIALOGUE SPEAKS_TO, declar DIALOGUE SPEAKS_TO, explain DIALOGUE SPEAKS_TO, mention DIALOGUE MENTIONS,
promis PROMISE PROMISES, repli DIALOGUE SPEAKS_TO, said DIALOGUE SPEAKS_TO, say DIALOGUE SPEAKS_TO, shout DIALOGUE SPEAKS_TO,
speak DIALOGUE SPEAKS_TO, spoke DIALOGUE SPEAKS_TO, state DIALOGUE SPEAKS_TO, suggest DIALOGUE SPEAKS_TO, tell DIALOGUE SPEAKS_TO,
told DIALOGUE SPEAKS_TO, threaten THREAT THREATENS, whisper DIALOGUE SPEAKS_TO, yell DIALOGUE SPEAKS_TO,
alli MEET INTERACTS, betray BETRAYAL BETRAYS, deceiv DECEIVES DECEIVES, follow MEET SERVES, friend MEET INTERACTS, help RESCUE SAVES,
join MEET INTERACTS, serv MEET SERVES, support MEET ALLIES,
admir MEET LOVES, fear BATTLE HATES, hat BATTLE HATES, lov MEET LOVES, trust MEET ALLIES,
rescu RESCUE SAVES, sav RESCUE SAVES, encount MEET INTERACTS, meet MEET INTERACTS,
build CREATE CREATES, creat CREATE CREATES, destroy DEATH DESTROYS, make CREATE CREATES, rul TRIAL RULES
"""
# Endings taken off a verb, the first that leaves three letters or more.
VERB_ENDINGS = ["ing", "ed", "es", "s", "er", "tion", "ness"]


def verb_rows() -> list[tuple[str, str, str]]:
    return [tuple(v.split()) for v in VERBS.replace("\n", " ").split(",") if v.strip()]


def _marks(classes: str) -> str:
    return "".join(MARKS[CLASSES.index(c)] for c in classes)


def _one(classes: str) -> str:
    """A token of one of the classes."""
    return f"[{_marks(classes)}][^{MARKS}]*"


def _run(c: str) -> str:
    """Tokens of a class, one or more: anything up to a mark of another class."""
    return f"{_marks(c)}[^{MARKS.replace(_marks(c), '')}]*"


_NP = f"(?:{_one('D')})?(?:{_run('J')})?{_run('N')}"
_ADVERBS = f"(?:{_run('R')})?"
_VP = f"(?:(?:{_one('XM')})?{_ADVERBS}{_one('V')}{_ADVERBS}|{_one('XM')}{_ADVERBS}|{_run('R')})"
#: Preposition and noun phrase, verb phrase, noun phrase, relative clause: leftmost, in this order.
PHRASE = f"({_one('PTF')}{_NP}|{_VP}|{_NP}|{_one('Q')}{_VP}(?:{_NP})?)"
_WORD_AFTER = f"([^{MARKS}]*)"
FIRST, LAST, VERB, LONE = f"^.{_WORD_AFTER}", f"[{MARKS}]{_WORD_AFTER}$", f"{_marks('V')}{_WORD_AFTER}", f"^.*[{_marks('XMR')}]{_WORD_AFTER}"


_KNOWN = {w: k for k, words in KNOWN.items() if k != "N" for w in reversed(words.split())} | dict.fromkeys(KNOWN["N"].split(), "N")
_PUNCTUATION, _UPPER, _TOKENS = regex.compile(r"\p{P}|-|'"), regex.compile(r"\p{Lu}"), regex.compile(TOKEN)
#: The same tokens of a text in ASCII, and places where the class of a word changes with the classes before it.
_PLAIN_TOKENS, _TURNS = re.compile(r"[A-Za-z0-9'\-]+|[!\"#%&'()*,\-./:;?@\[\\\]_{}]"), re.compile(r"(?<=[DJRF])[VXM]|(?<=T)N|(?<=M)(?<![DJRF]M)N")
WORDS_HELD = 1 << 17
_MARK = dict(zip(CLASSES, MARKS, strict=True))


def _base(w: str) -> str:
    """The class of a word on its own."""
    low = w.lower()
    if low in _KNOWN:
        return _KNOWN[low]
    if len(w) == 1 and _PUNCTUATION.fullmatch(w):
        return "S"
    if _UPPER.match(w):
        return "N"
    return next((k for k, ends in ENDINGS.items() if low.endswith(tuple(ends.split()))), "N")


class Tagger(dict):
    """The class of every word met so far, and the word behind its mark; at most ``WORDS_HELD`` are held."""

    def __missing__(self, w: str) -> tuple[str, str]:
        b = _base(w)
        self[w] = x = (b, _MARK[b] + w)
        return x

    def tagged(self, text: str) -> str:
        """The tokens of a text as one string of mark, class and token.

        After a determiner, adjective or adverb, and after "of", a verb is a noun; after a modal and after "to", a noun is a verb."""
        if len(self) > WORDS_HELD:
            self.clear()
        words = (_PLAIN_TOKENS if text.isascii() else _TOKENS).findall(text)
        if not words:
            return ""
        classes, out = zip(*map(self.__getitem__, words), strict=True)
        out = list(out)
        for m in _TURNS.finditer("".join(classes)):
            at = m.start()
            out[at] = _MARK["V" if m[0] == "N" else "N"] + words[at]
        return "".join(out)


def pieces(text: Column) -> Column:
    """The phrases of a text, each as its tokens behind their marks; null if there are none."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger, phrase = Tagger(), re.compile(PHRASE)
        for part in parts:
            yield pd.Series([(t and END.join(phrase.findall(tagger.tagged(t)))) or None for t in part], dtype=object)

    return F.split(F.pandas_udf(run, "string")(text), END, -1)  # one string crosses over faster than many


def phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, kind, head, phrase): phrases in order; kind is prep, verb, noun or clause, head its main word."""
    p = docs.select(id_col, pieces(F.col(text_col).cast("string")).alias("pieces")).select(id_col, F.posexplode("pieces").alias("place", "piece"))
    first = F.substring("piece", 1, 1)
    kind = F.when(first.isin(*_marks("PTF")), "prep").when(first == _marks("Q"), "clause").when(first.isin(*_marks("DJN")), "noun").otherwise("verb")
    p = p.select(id_col, "place", "piece", kind.alias("kind"), F.split("piece", f"[{MARKS[0]}-{MARKS[-1]}]", -1).alias("words"))  # the first is what stands before the first mark: nothing
    last, verb, lone = F.element_at("words", -1), F.regexp_extract("piece", VERB, 1), F.regexp_extract("piece", LONE, 1)
    # a clause's main word is that of its verb phrase: its verb, or the last word before the noun phrase
    other = F.when(F.instr("piece", _marks("V")) > 0, verb).when(F.col("kind") == "clause", lone).otherwise(last)
    head = F.when(F.col("kind") == "prep", F.get("words", F.lit(1))).when(F.col("kind") == "noun", last).otherwise(other)
    whole = F.substring(F.array_join("words", " "), 2, 1 << 30)
    return p.select(id_col, "place", "kind", head.alias("head"), whole.alias("phrase"))


def stem(word: Column) -> Column:
    low, out = F.lower(word), None
    for e in VERB_ENDINGS:
        hit = F.endswith(low, F.lit(e)) & (F.length(low) > len(e) + 2)
        cut = F.substring(low, F.lit(1), F.length(low) - len(e))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def events(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, place, event, relation, subject, object): verb phrases of narrated verbs with the nearest noun phrases around them.

    found: rows of ``phrases``.  The next noun phrase is the last one in falling order, so no frame is scanned twice."""
    spark = found.sparkSession
    verbs = F.broadcast(spark.createDataFrame(verb_rows(), "stem string, event string, relation string"))  # fixed: about a hundred rows
    noun = F.when(F.col("kind") == "noun", F.col("head"))
    up, down = (Window.partitionBy(id_col).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("place"), F.col("place").desc()))
    kept = found.filter(F.col("kind").isin("noun", "verb")).withColumn("noun", noun)
    kept = kept.withColumn("subject", F.last("noun", ignorenulls=True).over(up)).withColumn("object", F.last("noun", ignorenulls=True).over(down))
    hit = kept.filter(F.col("kind") == "verb").withColumn("stem", stem(F.col("head"))).join(verbs, "stem")
    return hit.select(id_col, "place", "event", "relation", F.coalesce("subject", F.lit("Unknown")).alias("subject"), F.coalesce("object", F.lit("Unknown")).alias("object"))


class Verbs(dict):
    """The event and relation of every verb met so far, None of those that narrate nothing; at most ``WORDS_HELD`` are held."""

    def __init__(self):
        self.known = {v: (event, relation) for v, event, relation in verb_rows()}

    def __missing__(self, w: str) -> tuple[str, str] | None:
        low = w.lower()
        cut = next((low[: -len(e)] for e in VERB_ENDINGS if low.endswith(e) and len(low) > len(e) + 2), low)
        if len(self) > WORDS_HELD:
            self.clear()
        self[w] = x = self.known.get(cut)
        return x


_NOUN_FIRST, _OTHER_FIRST = frozenset(_marks("DJN")), frozenset(_marks("PTFQ"))
_LAST_WORD, _VERB_MARK, _VERB_WORD = re.compile(LAST), _marks("V"), re.compile(VERB)


def _narrated(found: list[str], verbs: Verbs) -> Iterator[tuple[int, str, str, str, str]]:
    """(place, event, relation, subject, object) from the phrases of a text: a verb waits for the next noun phrase."""
    noun, waiting = "Unknown", []
    for place, piece in enumerate(found):
        if piece[0] in _NOUN_FIRST:
            noun = _LAST_WORD.search(piece)[1]
            for w in waiting:
                yield *w, noun
            waiting.clear()
        elif piece[0] not in _OTHER_FIRST:
            head = _VERB_WORD.search(piece) if _VERB_MARK in piece else _LAST_WORD.search(piece)
            if hit := verbs[head[1]]:
                waiting.append((place, *hit, noun))
    for w in waiting:
        yield *w, "Unknown"


def narrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, event, relation, subject, object): ``events`` of ``phrases`` within each document's row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, phrase, verbs = Tagger(), re.compile(PHRASE), Verbs()
        for b in batches:
            rows = [(k, *e) for k, t in enumerate(b.column(1).to_pylist()) if t for e in _narrated(phrase.findall(tagger.tagged(t)), verbs)]
            if rows:
                of, place, *words = zip(*rows, strict=True)
                columns = [b.column(0).take(pa.array(of)), pa.array(place, pa.int32()), *[pa.array(w, pa.string()) for w in words]]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "place", "event", "relation", "subject", "object"])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("place", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("event", "relation", "subject", "object")]]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


_WORD = r"[A-Za-z0-9_'\-]+"


def _syllables(w: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(F.lower(w), "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}"))))


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, sentences, syllables, mean_length, deviation, variety, flow, level, speaking_seconds) of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = F.transform(F.filter(F.split(text, "[.!?]+", -1), lambda s: F.trim(F.translate(s, "\n\t\r", "   ")) != ""), lambda s: F.regexp_count(s, F.lit(_WORD)))
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    d = docs.select(id_col, lengths.alias("l"), F.size(words).cast("long").alias("words"), F.aggregate(words, F.lit(0), lambda a, w: a + _syllables(w)).cast("long").alias("syllables"))
    total = lambda f: F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + f(x).cast("long"))
    edges = [(None, 1), (1, 6), (6, 15), (15, 25), (25, 39), (39, None)]
    inside = lambda lo, hi: lambda x: ((F.lit(True) if lo is None else x > lo) & (F.lit(True) if hi is None else x <= hi)).cast("int")
    d = d.select("*", F.size("l").cast("long").alias("sentences"), total(lambda x: x).alias("s1"), total(lambda x: x.cast("long") * x).alias("s2"), *[total(inside(*e)).alias(f"b{k}") for k, e in enumerate(edges)])
    n = F.col("sentences").cast("double")
    entropy, used = F.lit(0.0), F.lit(0)
    for k in range(len(edges)):
        p = F.col(f"b{k}") / n
        entropy = entropy - F.when(F.col(f"b{k}") > 0, p * F.log2(p)).otherwise(0.0)
        used = used + (F.col(f"b{k}") > 0).cast("int")
    d = d.withColumn("variety", F.when(used > 1, F.floor(100 * entropy / F.log2(used.cast("double")) + 0.5)).otherwise(0).cast("long"))
    d = d.withColumn("deviation", F.when(n > 0, F.sqrt(F.col("sentences") * F.col("s2") - F.col("s1") * F.col("s1")) / n).otherwise(0.0))
    flow = F.when(n > 0, F.floor(F.least(F.lit(100.0), F.col("deviation") / 8 * 100) * 0.6 + F.col("variety") * 0.4 + 0.5)).otherwise(0).cast("long")
    grade = 0.39 * F.col("words") / n + 11.8 * F.col("syllables") / F.col("words") - 15.59
    level = F.when((F.col("words") == 0) | (n == 0), "N/A").when(grade < 1, "Kindergarten").when(grade < 6, "1st-5th Grade").when(grade < 9, "6th-8th Grade").when(grade < 13, "9th-12th Grade").when(grade < 17, "College Level").otherwise("Graduate Level")
    mean = F.when(n > 0, F.floor(F.col("words") * 10 / n + 0.5) / 10).otherwise(0.0)
    return d.select(id_col, "words", "sentences", "syllables", mean.alias("mean_length"), F.round("deviation", 6).alias("deviation"), "variety", flow.alias("flow"), level.alias("level"), F.ceil(F.col("words") * 60 / 150.0).cast("long").alias("speaking_seconds"))
