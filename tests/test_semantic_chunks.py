"""Semantic chunks against a plain fold."""

import math
import re
import zlib

from lodestone.functions import chunks


def vector(text):
    v = [0] * 64
    for w in re.findall(r"\w+", text.lower()):
        v[zlib.crc32(w.encode()) % 64] += 1
    return v


def cos(a, b):
    m = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / m if m else 0.0


def fold(text, least, most):
    """Texts of chunks, each as the list of its units."""
    parts = []
    for line in (text or "").split("\n"):
        if len(line.strip()) > most:
            inner = [line[a:b] for a, b in chunks.split(line)]
            parts += [(s, n == len(inner) - 1) for n, s in enumerate(inner)]
        elif line.strip():
            parts.append((line.strip(), True))
    out = []
    for k, (s, structural) in enumerate(parts):
        size = sum(map(len, out[-1])) if out else 0
        if not out or size + len(s) > most or (size >= least and (structural or cos(vector(parts[k - 1][0]), vector(s)) < 0.6 - 1e-12)):
            out.append([])
        out[-1].append(s)
    return out


def test_every_document_equals_the_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for least, most in ((200, 800), (50, 120)):
        got = {}
        for r in sorted(chunks.semantic_chunked(docs, least, most).collect(), key=lambda r: (r.doc_id, r.place)):
            got.setdefault(r.doc_id, []).append((texts[r.doc_id][r.start : r.end], r.units))
        want = {i: fold(t, least, most) for i, t in texts.items()}
        assert set(got) == {i for i, w in want.items() if w}
        for i, found in got.items():
            assert [n for _, n in found] == [len(c) for c in want[i]]
            assert all(t.startswith(c[0]) and t.endswith(c[-1]) for (t, _), c in zip(found, want[i], strict=True))


def test_topics_and_odd_rows(spark):
    text = " ".join(["Apple pie, apple tart and apple cake."] * 3 + ["Ships sail on wide seas."] * 2)
    assert [n for _, _, n in chunks.semantic(text, 30, 150)] == [3, 2]  # sentences, as the line is longer than the most; the topic changes once
    assert [n for _, _, n in chunks.semantic("one two\nthree four\nfive", 8, 100)] == [2, 1]  # a line end past the least size
    assert [n for _, _, n in chunks.semantic("aaaa\nbbbb\ncccc", 100, 9)] == [2, 1]  # never longer than the most
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "x"), (4, "one")], "doc_id long, text string")
    assert [tuple(r) for r in chunks.semantic_chunked(docs).collect()] == [(4, 0, 0, 3, 1)]
