"""The fixed columns of the queries against plain rewrites of what they are defined as."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import pii, quality, toxicity

WHERE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", "text").collect()}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """(start, number of the kind, kind, end) of the base spans."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), n, kind, m.end()) for n, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0]))


def test_base_spans_of_personal_data(spark, texts):
    got = pii.op9_pii(spark, WHERE).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        spans = base_spans(texts[r.doc_id])
        n = Counter(kind for _, _, kind, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"]), r.doc_id
        named = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest(), r.doc_id
        assert set(named) <= set(r.spans.split(",")) or not named
        found += len(named)
    assert found > 5


def test_base_of_the_quality_rules(spark, texts):
    got = quality.op7_quality_rules(spark, WHERE).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert any(r.base_failed for r in got) and any(r.kept for r in got)


def test_columns_of_the_toxicity_query(spark, texts):
    got = toxicity.op3_toxicity(spark, WHERE).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
