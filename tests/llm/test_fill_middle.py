"""Fill-in-middle against a plain rewrite: units by regular expression, cuts by counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = ["a", "bc ", " ", "\n", "\t\x0b", "é", "日本", "😀", "<", "<P", "P>", "<S", "S>", ">", "<M", "\x00", "\x85", " ", "word"]


def plain_rewrite(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(n, seed=5):
    r = random.Random(seed)
    made = ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return [*made, None, "", " ", "\n\n", "x", "<P>", "a <M> b", "é" * 5000, "long word " * 20000, " lead", "trail "]


def test_equals_the_plain_rewrite(spark):
    rows = list(enumerate(texts(400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert {tuple(r) for r in got} == {plain_rewrite(*r) for r in rows} and len(got) == len(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_round_trip_is_exact(spark):
    rows = list(enumerate(texts(300, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_middle.transform(docs, rate=100)
    back = made.select("doc_id", fill_middle.restored(made["output"], made["form"]).alias("back")).collect()
    assert {tuple(r) for r in back} == {(i, t or "") for i, t in rows}


def test_nulls_repeats_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a b c", 1, "x"), (3, "a b", 2, "y"), (3, "a b", 2, "y")], "doc_id long, text string, N int, output string")
    out = fill_middle.transform(docs)
    assert out.columns == ["doc_id", "text", "N", "output", "n_", "form", "prefix_chars", "middle_chars", "output_"]
    got = out.collect()
    assert len(got) == 3 and got[1] == got[2] and {(r.N, r.output) for r in got} == {(1, "x"), (2, "y")}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_long_texts_cross_lanes():
    """The lanes' marks equal those of one lane, whatever the length of the input."""
    a = fill_middle.Automaton()
    for text in ("é<P>x " * 3001, "<" * 9000 + "<M>", "日本 \n" * 5000, "ab"):
        symbols = a.classes[np.frombuffer(text.encode(), np.uint8)]
        state, marks = a.start, []
        for c in symbols.tolist():
            marks.append(int(a.marks[state * a.width + c]))
            state = int(a.step[state * a.width + c]) // a.width
        assert a.scan(symbols).tolist() == marks
        assert sum(m & fill_middle.CODE_POINT for m in marks) == len(text)


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<a", "a>", "<m>"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>y", "<M>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, sentinels=bad)
