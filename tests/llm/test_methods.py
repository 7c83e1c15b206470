"""The methods of the operators: grammar, field, thresholds, line groups, clashing names, and the pipeline stage by stage."""

import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.checkpoints import Scratch
from lodestone.llm import _text, decontam, line_dedup, mixing, near_dedup, pii, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity
@pytest.fixture(scope="module")
def score():
    return toxicity.Model({"idiot": 4.9, "2:zorb*": 4.0}, np.array([2.5, -3.0]), -4.4, 5e-4).scorer()


def test_clauses_not_words(score):
    assert score("You are an idiot.") >= toxicity.CUTOFF
    for calm in ("She never called you an idiot.", 'He said: "you idiot"', "He said you are an idiot.", "«You idiot», she wrote", None, "", "A plain text."):
        assert score(calm) < 0.5, calm
    assert score("I will kill you") >= toxicity.CUTOFF > score("kill the process") and score('He said: "I will kill you"') < 0.5


def test_quotes_end_with_their_paragraph(score):
    assert score('A 5" pipe. You are an idiot.') >= toxicity.CUTOFF
    assert score('An open " quotation\nYou are an idiot.') >= toxicity.CUTOFF


def test_patterns_of_two_matches(score):
    assert score("zorblat once in a text") < 0.5 < toxicity.CUTOFF <= score("you zorblat and you zorbling again")


def test_composed_machine_is_the_product():
    machines = [toxicity._insult(), toxicity._target(), toxicity._negation(), toxicity._report(), toxicity._threat()]
    rng = random.Random(1)
    for _ in range(50):
        alone, together = [0] * 5, 0
        for y in rng.choices(toxicity.SYMBOLS, k=30):
            alone = [m[s][y] for m, s in zip(machines, alone, strict=True)]
            together = toxicity._STEPS[together][y]
            assert toxicity._STATES[together] == tuple(alone)


# ---- personal data
def test_pii_any_digit_and_long_runs():
    nothing = pii.Field(np.zeros((pii.N_FEATURES, len(pii.LABELS))), *[np.zeros((len(pii.LABELS),) * 2)] * 2)
    odd = "".join(chr(c) for c in range(0x2FFFF) if chr(c).isdigit())
    for text in ("see 1.²3.4.5 there", "0" * 5000 + ".0.0.0", odd, " ".join(odd), "(" * 30000 + "1", "1" * 30000, "1." * 10000, "a@" * 10000, "+1" * 10000):
        pii.all_spans(text, nothing)
    rng = random.Random(2)
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice("0125.9 @+-a") for _ in range(40))
        want = [(m.start(), 1, m.end()) for m in plain.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[1] == 1] == want
        assert pii._emails(t) == [(m.start(), 0, m.end()) for m in pii._EMAIL.finditer(t)]


def test_field_equals_enumeration():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(0, 0.5, (pii.N_FEATURES, k)), rng.normal(0, 0.4, (k, k)), rng.normal(0, 0.4, (k, k)))
    field.chain, field.skip = field.chain + field.chain.T, field.skip + field.skip.T
    for text in ("a1 b2 and then a1", "x1 y2 z3", "q9 only"):  # no loops: exact
        found = pii.nodes(text)
        edges = [(i, i + 1, field.chain) for i in range(len(found) - 1) if pii.chained(found, i + 1)] + [(a, b, field.skip) for a, b in pii.skip_edges(found)]
        unary = [field.weights[pii.features(c, found[i - 1][2] if i else "", found[i + 1][2] if i + 1 < len(found) else "", pii.cued(text, s))].sum(axis=0) for i, (s, _, c) in enumerate(found)]
        total = np.zeros((len(found), k))
        for labels in itertools.product(range(k), repeat=len(found)):
            w = math.exp(sum(u[x] for u, x in zip(unary, labels, strict=True)) + sum(p[labels[a], labels[b]] for a, b, p in edges))
            for i, x in enumerate(labels):
                total[i, x] += w
        got = field.marginals(text, found, [None] * len(found))
        assert np.abs(got - total / total.sum(axis=1, keepdims=True)).max() < 0.01


def test_only_a_skip_edge_finds_the_bare_secret(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)) + "a1"
    texts = []
    for i in range(200):
        k = key()
        texts.append(f'set {"token" if i % 2 else "label"} = "{k}" here, item {i}, and later use {k} again on 10.0.0.{i}')
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii.train(docs)
    same = pii.train(docs)
    assert np.array_equal(field.weights, same.weights)
    k = key()
    text = f'set token = "{k}" here, item 7, and later use {k} again on 10.0.0.7'
    with_skip = [s for s in pii.all_spans(text, field)[1] if s[1] == pii.SECRET - 1]
    without = [s for s in pii.all_spans(text, pii.Field(field.weights, field.chain, np.zeros_like(field.skip)))[1] if s[1] == pii.SECRET - 1]
    assert len(with_skip) == 2 and len(without) < 2
    out = {r["doc_id"]: r for r in pii.find(docs, field).collect()}
    assert out[1]["n_secret"] >= 1 and out[0]["n_secret"] == 0 and out[0]["n_ip"] == 1


# ---- quality
def test_fixed_sequence_controls_risk():
    assert quality.upper_bound(3, 50, 0.05) == pytest.approx(0.14784, abs=1e-4)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-9)
    assert quality.chosen_step([0, 0, 0, 9], 100, 0.05, 0.05) == 2 and quality.chosen_step([0], 20, 0.05, 0.05) == -1
    rng = np.random.default_rng(6)
    rates = np.linspace(0.0, 0.12, 25)  # true false rejections of each step; steps up to 0.05 are allowed
    wrong = 0
    for _ in range(400):
        u = rng.random(300)
        j = quality.chosen_step([int((u < r).sum()) for r in rates], 300, 0.05, 0.05)
        wrong += j >= 0 and rates[j] > 0.05
    assert wrong / 400 < 0.08


def test_every_stratum_gets_cutoffs(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(800):
        good = i % 4 != 0
        w = [f"w{rng.randrange(3000)}" for _ in range(80)]
        data.append((i, " ".join(w) if good else " ".join(x + "##$" for x in w), ("aa", "bb")[i // 400]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*data, (None, None, None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, *labels, (None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality.judged(docs, lab).collect()}
    assert not out[None]
    for s in (0, 1):
        part = range(400 * s, 400 * s + 400)
        assert sum(not out[i] for i in part if i % 4 == 0) > 90 and sum(not out[i] for i in part if i % 4) <= 15


# ---- line groups
def test_hot_groups_of_near_copies_are_not_squared(spark):
    """Against the centres of a key, candidates follow the sets; all pairs of them would be 79,800."""
    rows = [(5, i, 0, 10, 0, 0, 0) for i in range(400)]  # similar enough by all filters
    sets = spark.createDataFrame(rows, "key long, id long, line int, n int, at int, parity long, wide long")
    centres = sets.filter(F.col("id") < line_dedup.CENTRES)
    found = line_dedup._candidates(sets, centres, 0.8, "x").union(line_dedup._candidates(centres, sets, 0.8, "y")).distinct().collect()
    assert len(found) <= line_dedup.CENTRES * 400 and {r["id"] for r in found} == set(range(1, 400))
    assert all(r["e_id"] < r["id"] for r in found)


def test_centres_lose_no_partner(spark):
    rng = random.Random(5)
    names = [f"v{i}" for i in range(4000)]
    words = spark.createDataFrame([(w,) for w in names], "w string").filter("pmod(xxhash64(w), 64) = 0")
    rare, *pool = sorted(r["w"] for r in words.collect())[:21]  # one parity bit for all: every pair passes the filters
    lines = [[rare, *c] for c in rng.sample(list(itertools.combinations(pool, 4)), 300)]
    lines.insert(25, lines[20][:4])  # similar to line 20 only, after 20 others that pass the filters
    texts = [" ".join(w) for w in lines] + [" ".join(pool * 1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    want = {b for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 25 in want and {r["doc_id"] for r in line_dedup.duplicates(docs).collect()} == want


@pytest.mark.parametrize("mask", [63, 127])
def test_parities_bound_the_difference(spark, mask):
    """Sets differ by at least the number of cells whose parities differ, and by as many modulo two."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(200):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 300))))
        b = np.union1d(rng.choice(a, max(1, int(len(a) * rng.uniform(0.5, 1))), replace=False), rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 60))))
        rows.append((a.tolist(), b.tolist(), len(np.setxor1d(a, b))))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>, apart int")
    bits = line_dedup._BITS if mask == 63 else [0] * 64 + line_dedup._BITS
    parity = lambda c: line_dedup._parity(F.col(c), bits, mask)
    got = pairs.select("apart", F.bit_count(parity("a").bitwiseXOR(parity("b"))).alias("bound")).collect()
    assert all(r["bound"] <= r["apart"] for r in got) and any(r["bound"] > 20 for r in got)
    assert mask == 127 or all((r["bound"] - r["apart"]) % 2 == 0 for r in got)


def test_unlike_long_lines_are_no_candidates(spark):
    rng = random.Random(3)
    texts = [" ".join(["rare", *(f"v{rng.randrange(5000)}" for _ in range(150))]) for _ in range(200)]
    like = texts[7].split()
    like[9] = "changed"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(like)])), "id long, text string")
    ranks = np.arange(1 << line_dedup.CELL_BITS)
    cell = spark.sql("SELECT shiftrightunsigned(xxhash64('rare'), 48)").first()[0]
    ranks[[0, cell]] = ranks[[cell, 0]]  # the word that all lines share is the rarest one
    sets = line_dedup._described(docs, ranks, 0.8)
    got = line_dedup._candidates(*line_dedup._dealt_out(sets, 0.8), 0.8).distinct().collect()
    assert {(r["id"], r["e_id"]) for r in got} == {(200, 7)}


def test_sweep_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before = files()
    out = Scratch(spark, "swept", sweep=True).table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("many", [1, 256])
def test_line_dedup_is_native_and_whole(spark, monkeypatch, many):
    def python(*_):
        raise AssertionError("Python on the executors")

    for name, kind in (("mapInArrow", type(spark.range(1))), ("applyInArrow", type(spark.range(1).groupBy()))):
        monkeypatch.setattr(kind, name, python)
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") + str(int(rng.paretovariate(0.7)) % 60) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    texts = []
    for _ in range(120):  # near copies, among them large groups with one line in common
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice([base[0], base[1], rng.choice(base)]))
            for _ in range(rng.randint(0, max(1, len(words) // 6))):
                words[rng.randrange(len(words))] = "x" + str(rng.randint(0, 400))
            lines.append(rng.choice([" ", "  ", "\t", "\r\x0b\x0c"]).join(rng.choice([[], [""]]) + words))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [(i, n, set(line.split())) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    want = {(i, n) for k, (i, n, s) in enumerate(lines) if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for _, _, o in lines[:k])}
    got = {(r["doc_id"], r["line"]) for r in line_dedup.duplicates(docs, many=many).collect()}
    assert got == want and 20 < len(want) < len(lines) - 20


# ---- near-duplicates
def test_signatures_hold_little_memory():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(350)) for _ in range(1200)]  # 2 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    kept = dict(_text._POWERS)
    _text._POWERS.clear()  # as in a fresh worker
    tracemalloc.start()
    n = sum(b.num_rows for b in near_dedup.signatures(iter([batch]), near_dedup.BANDS, near_dedup.ROWS))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _text._POWERS.update(kept)
    assert n == len(texts) and most < 64e6, most


# ---- names
def test_clashing_columns(spark):
    names = ["gone_id", "gone", "again_id", "m_place", "m_full", "m_rest", "m_order", "m_range", "m_edge", "m_before", "m_sum", "m_copies", "m_tokens", "m_domain", "m_epoch", "_shard", "_shard_id"]
    ddl = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, f"some words {i % 2}\nsome words {i % 2}", "en", "src1", *names) for i in range(4)], ddl)
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    for out in (near_dedup.keep_one(docs), decontam.clean(docs, items), line_dedup.clean(docs), mixing.mixture(docs, fraction=4.0)):
        assert out.columns == docs.columns and [r["m_copies"] for r in out.collect()].count("m_copies") == out.count() > 0
    assert mixing.mix(docs).columns[-5:] == list(mixing.ADDED)


# ---- the pipeline, each stage on its own input
def _similarity(a, b):
    s = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in (a, b)]
    both = sum((s[0] & s[1]).values())
    return both / max(1, sum(s[0].values()) + sum(s[1].values()) - both)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(k, text(40)) for k in range(3)]
    rows, labels = [], []
    for i in range(160):
        t = text(rng.randrange(30, 70))
        if i % 8 == 0:
            t = f"you grumbag and you are a grumbag {t} grumbag."
        elif i % 8 == 1 and i > 8:
            w = rows[-2][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif i % 8 == 2:
            t = f"{t} {items[i % 3][1]} {text(5)}"
        rows.append((i, t, rng.choice(["en", "de", None]), f"src{rng.choice([1, 1, 1, 2, 3])}", len(t)))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(160, None, None, None, 0), (161, "", "en", "src1", 0), (None, text(30), "en", "src1", 0), (7, rows[7][1], *rows[7][2:])]
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    now = spark.read.parquet(f"{where}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, where).write.parquet(f"{where}/out{k}")
        before, out = now, spark.read.parquet(f"{where}/out{k}")
        have, left = [tuple(r) for r in before.collect()], Counter(tuple(r) for r in out.collect())
        words = {r[0]: WORD.findall((r[1] or "").lower()) for r in have}
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{where}/labels.parquet"))
            score = model.scorer()
            assert left == Counter(r for r in have if score(r[1]) < toxicity.CUTOFF)
            assert {r[0] for r in have} - {r[0] for r in left} == {i for i in range(0, 160, 8)}
        elif name == "near_dedup":
            ids = sorted(i for i in words if i is not None)
            exact = {i: WORD.findall(next(r[1] for r in have if r[0] == i) or "") for i in ids}
            root = {i: i for i in ids}
            for a, b in itertools.combinations(ids, 2):
                if exact[a] and exact[b] and _similarity(exact[a], exact[b]) >= 0.8:
                    x, y = sorted((root[a], root[b]))
                    root = {i: x if r == y else r for i, r in root.items()}
            want = {i for i in ids if root[i] == i}
            assert {r[0] for r in left} - {None} == want and all(n == 1 for r, n in left.items() if r[0] is not None)
        elif name == "decontamination":
            hit = {i for i, w in words.items() for _, t in items if any(_similarity(w[max(0, s) : max(0, s + 40)], t.lower().split()) >= 0.8 for s in range(-39, len(w)))}
            assert left == Counter(r for r in have if r[0] not in hit) and hit
        else:
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/out{k - 1}/*.parquet'")
            if name == "mixing":
                copies = {r[0]: r[5] for r in con.sql(mixing.oracle()).fetchall()}
                assert Counter(r[0] for r in left.elements()) == Counter({i: n for i, n in copies.items() if n})
            else:
                assert sum(left.values()) == len(have) and max(r[4] for r in left) <= sharding.SHARD_BYTES
        now = out


def test_line_dedup_does_not_depend_on_the_order_of_words(spark, monkeypatch):
    import numpy as np

    from lodestone.llm import line_dedup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    find = lambda: {tuple(r) for r in line_dedup.duplicates(docs).collect()}
    counted = line_dedup.rarity(docs.withColumnRenamed("doc_id", "id"))
    want = find()
    for ranks in (len(counted) - 1 - counted, np.zeros_like(counted)):
        monkeypatch.setattr(line_dedup, "rarity", lambda _, ranks=ranks: ranks)
        assert find() == want
    assert want
