"""Each operator against brute force or defined results on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontam, html_text, line_dedup, mixing, near_dedup, pii, quality, sharding, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, node string"


def rng_text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, 5000, n))


@pytest.fixture(scope="module")
def rows():
    long = rng_text(1, 3000)
    base = rng_text(2, 120)
    near = base.split()
    near[60] = "changed"
    passage = rng_text(3, 60)
    texts = [long, base, base, " ".join(near), None, "", " \n\t ", "one", rng_text(4, 40) + "\n" + passage + "\n" + rng_text(5, 20), rng_text(6, 30) + " " + passage + " end", "a b c d e " * 40, "é ü — 漢字 " * 30]
    return [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i != 5 else None, 0, 7, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def similarity(a, b, k=5):
    s = []
    for t in (a, b):
        w = WORD.findall(t or "")
        s.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else []))
    both = sum((s[0] & s[1]).values())
    return both / max(1, sum(s[0].values()) + sum(s[1].values()) - both)


def test_near_dedup(docs, rows, empty):
    want = {i: i for i, *_ in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and similarity(a[1], b[1]) >= 0.8:
                want[b[0]] = min(want[b[0]], want[a[0]])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == want and got[2] == 1 and got[3] == 1
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i}


def test_near_dedup_keeps_one_row_of_an_id(spark):
    a, b = rng_text(81, 60), rng_text(82, 60)
    data = [(1, a), (1, a), (2, a), (3, b), (3, b), (3, b), (4, None), (4, None), (None, a), (None, a), (5, "alone")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.keep_one(docs).collect())) == Counter({(1, a): 1, (3, b): 1, (4, None): 1, (None, a): 2, (5, "alone"): 1})


def test_signature_is_unbiased():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a, b = r.integers(1, 6, 60), r.integers(1, 6, 60)
        h = r.integers(0, 2**63, 60).astype(np.uint64)
        s = near_dedup.bag_minhash(np.repeat([0, 1], 60), np.concatenate((h, h)), np.concatenate((a, b)), 2, 256)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015


def test_decontamination(spark, docs, rows, empty):
    passage = rng_text(3, 60)
    items = spark.createDataFrame([(1, passage), (2, rng_text(99, 30)), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()}
    assert got == {(8, 1), (9, 1)}
    assert decontam.clean(docs, items).count() == len(rows) - 2
    assert decontam.matches(empty, items).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    words = {1: rng_text(71, 50).split(), 2: rng_text(72, 60).split(), 3: rng_text(73, 30).split(), 4: ["la", "li", "lo"] * 9 + rng_text(74, 8).split()}
    fill = lambda n: [f"f{rng.randrange(900)}" for _ in range(n)]
    texts = [fill(40) + words[1][25:] + words[1][:25] + fill(40), words[2][20:] + words[2][:20] + fill(9), fill(70) + words[3][:-2], words[3][2:], words[4][3:] + words[4][:3] + fill(5)]
    for _ in range(12):
        w = list(words[rng.randint(1, 4)])
        cut = rng.choice([0, 0, len(w) // 2])
        w = w[cut:] + w[:cut]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
        texts.append(fill(rng.randint(0, 30)) + w + fill(rng.randint(0, 30)))

    def windows(w, m):
        return (w[max(0, s) : s + m] for s in range(1 - m, len(w)))

    want = {(d, i) for d, w in enumerate(texts) for i, x in words.items() if any(similarity(" ".join(v), " ".join(x)) >= 0.8 for v in windows(w, len(x)))}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()}
    assert {(0, 1), (1, 2)} <= want and got == want


def test_toxicity(spark):
    r = np.random.default_rng(3)
    data, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [f"word{x}" for x in r.integers(0, 300, 30)]
        if bad:
            w[5], w[15] = "zorblat", "zorbling"
        data.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    data += [(2000, None), (2001, ""), (None, "zorblat zorbling")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.scores(docs, toxicity.train(docs, lab)).collect()}
    held = [i for i, _, _ in labels if out[i]["held_out"]]
    assert held and all(out[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert out[2000]["predicted"] == 0 and 0 <= out[2001]["score"] <= 1
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.scores(docs, none).filter("predicted = 1").count() == 0


def test_html():
    page = "<html><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Title</h1><p>First, long enough, text of the article &amp; more.<p>Second   paragraph, with\n commas, too.</article><div id=comments><p>Reader comment, long, with commas, here.</p></div><form>Go</form><footer>Foot</footer><script>var a = '<p>x</p>'</script>"
    assert html_text.extract(page) == "Title First, long enough, text of the article & more. Second paragraph, with commas, too."
    for odd in (None, "", "<", "<p", "plain text only", "<!-- open", "<p>cut &am", "<script>never closed"):
        assert isinstance(html_text.extract(odd), str)
    assert html_text.extract("plain text only") == "plain text only"
    assert html_text.extract("<div>" * 3000 + "deep text, with a comma and length" + "</div>" * 3000) == "deep text, with a comma and length"


def test_html_keeps_what_only_looks_hidden():
    kept = "<a href='/hidden-valley'>one</a> <b title='the hidden cost'>two</b> <i data-hidden='false'>three</i> <a href=/x?id=search>four</a> <em onclick=\"f('class=menu')\" data-style='display:none'>five</em> <math><mi>six</mi></math> <object>seven</object>"
    gone = "<b hidden>x</b><b HIDDEN=''>x</b><b aria-hidden = true>x</b><b style='color:red; display: none'>x</b><b class = 'top menu'>x</b><b a=1 id=search>x</b><b role='menu'>x</b>"
    page = f"<article><p>Long enough, article text: {kept}{gone}, with commas.</p><figure><img src=a><figcaption>A caption</figcaption></figure><p>And a second paragraph, long enough.</p></article>"
    assert html_text.extract(page) == "Long enough, article text: one two three four five six seven , with commas. A caption And a second paragraph, long enough."


def test_mixing_matches_sql(docs, rows, empty):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]))
    got = {r["doc_id"]: (r["m_tokens"], r["m_copies"]) for r in mixing.mix(docs).collect()}
    want = {r[0]: (r[4], r[5]) for r in con.sql(mixing.oracle()).fetchall()}
    assert got == want
    assert mixing.mixture(docs).columns == docs.columns and mixing.mix(empty).count() == 0


def test_line_dedup(spark, empty):
    a = " ".join(f"x{i}" for i in range(20))
    b = a.replace("x3 ", "y3 ")
    docs = spark.createDataFrame([(1, a + "\nother line\n\n"), (2, "other line\n" + b), (3, None), (4, ""), (None, a), (5, "fresh\nfresh")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.report(docs).collect()}
    assert got == {1: (4, ""), 2: (2, "0,1"), 3: (0, ""), 4: (1, ""), None: (1, ""), 5: (2, "1")}
    assert line_dedup.clean(docs).filter("doc_id = 2").first()["text"] == ""
    assert line_dedup.report(empty).count() == 0


def test_quality(spark, docs, empty):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judged(docs, lab).collect()}
    assert out[4]["n_words"] == 0 and out[4]["base_failed"] and not out[4]["kept"]
    assert out[10]["n_repeat_words"] == 200 and out[10]["base_failed"]
    assert out[0]["kept"] and quality.judged(empty, lab).count() == 0
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)


@pytest.mark.parametrize("groups", [1, 7])
def test_substrings(docs, rows, empty, groups):
    first = {}
    split = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i, w in split.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in substrings.dedup(docs, groups=groups).collect()}
    assert got == want and substrings.dedup(empty).count() == 0


def test_pii(spark, empty):
    texts = ["mail a.b@mail.example.com now", "ip 10.0.0.1 or 300.1.1.1", "card 4111 1111 1111 1111.", "call +1 (555) 123-4567!", None, "", "no data", "x@y a@b.c@d.e 1.2.3.4.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find(docs, pii.train(docs)).collect()}
    assert [out[i][k] for i, k in enumerate(("n_email", "n_ip", "n_card", "n_phone"))] == [1, 1, 1, 1]
    assert out[4]["spans"] == "" and out[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for t in texts:
        if t:
            assert pii._emails(t) == [(m.start(), 0, m.end()) for m in pii._EMAIL.finditer(t)]
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_pii_repeats_are_linked():
    text = "+491701234567 is my number, when in doubt please ring 491701234567"
    found = pii.nodes(text)
    assert pii.skip_edges(found) == [(0, 1)]
    assert pii.skip_edges(pii.nodes("5551234 5551234")) == []  # a chain edge joins them
    k = len(pii.LABELS)
    agree = pii.Field(np.zeros((pii.N_FEATURES, k)), np.zeros((k, k)), 3 * np.eye(k))
    assert agree.marginals(text, found, [4, None])[1, 4] > 0.8
    many = " then ring ".join(["5551234"] * 60)
    p = agree.marginals(many, pii.nodes(many), [4] + [None] * 59)
    assert p[1:, 4].min() > 0.8
    near = [0.9 * np.eye(k), 0.4 * np.eye(k)]  # weak edges, loops of chain and skip edges
    loops = " x ".join(["5551234 7771234"] * 30)
    p = pii.Field(np.zeros((pii.N_FEATURES, k)), *near).marginals(loops, pii.nodes(loops), [4] + [None] * 59)
    assert np.isfinite(p).all() and (p.argmax(axis=1) == 4).all()


@pytest.mark.parametrize("limit", [400, 5000])
def test_sharding(spark, docs, rows, empty, limit):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]))
    got = sorted(tuple(r) for r in sharding.shard(docs, limit).collect())
    assert got == sorted(con.sql(sharding.oracle(limit)).fetchall())
    same = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    out = sharding.shard(same, 500).collect()
    assert len(out) == 50 and max(r["shard_bytes"] for r in out) <= 500
    assert sharding.shard(empty).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(int(rng.paretovariate(0.7)) % 90) for _ in range(rng.randint(1, 24))] for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["x" + str(rng.randint(0, 30))], [words[at], "y" + str(rng.randint(0, 5))]])
                words = words or ["z"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [(i, n, set(line.split())) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line.split()]
    want = {(i, n) for k, (i, n, s) in enumerate(lines) if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for _, _, o in lines[:k])}
    got = {(r["doc_id"], r["line"]) for r in line_dedup.duplicates(docs).collect()}
    assert got == want and 20 < len(want) < len(lines) - 20
