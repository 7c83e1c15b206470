"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from fixed patterns (email, ip, card, phone).  The field then
labels the document's *active* words, those with a digit or an @: one node each,
labels none/email/ip/card/phone/secret, node potentials from shape and context
features (a secret is learned from long mixed words that stand after a cue such as
``token =``), chain edges
between neighbours at most ``CHAIN_GAP`` characters apart, and skip edges from each
word to the first one with the same or a similar core (equal letters and digits, or
equal digits), however far away, unless a chain edge joins the two.  Loopy belief propagation makes the labels of a document agree; a base span pins
its words.  A word labelled with at least ``SURE`` outside all base spans is an
added span.

Node weights are a softmax regression on at most ``TRAIN_WORDS`` words of at most
``TRAIN_DOCS`` documents (those of the smallest hash), labelled by the patterns; the
features describe shape and context, not the patterns.  Edge potentials are the
smoothed log-odds of agreement in that sample.  Skip edges link each word to one
earlier word, the first of its group, so a document of n active words has at most
2 n edges and evidence crosses a group in few steps, however many repeats it holds.

Defined results: null text is empty and has no spans; rows with a null id are
searched; documents without active words keep their base spans (none); repeated
rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")  # base spans have the first four kinds
LABELS = ("none", *ALL_KINDS)
SECRET = LABELS.index("secret")
TRAIN_DOCS, TRAIN_WORDS = 20_000, 60_000
SURE = 0.9
CHAIN_GAP = 2
SWEEPS = 200  # at most; messages settle long before
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does: within one, what follows is the same
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ACTIVE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_OPEN = re.compile(r"[^0-9A-Za-z@+(]*")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# Words after which a long mixed word is taken for a secret in training.
_CUE = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|key|bearer|auth)[^0-9A-Za-z]{0,5}\Z", re.I)
_CUE_REACH = 24


def _digits(s: str) -> int:
    """The number of ASCII digits."""
    return sum("0" <= c <= "9" for c in s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, in order."""
    out = []
    if "@" in text:
        # the local part holds no @, so the search may start after the last blank before one
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)] if len(text) < 4096 else _emails(text)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= _digits(m[0]) <= 15]
    return sorted(out)


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")


def _emails(text: str) -> list[tuple[int, int, int]]:
    """The same matches as a plain scan, but only looking around each @: a match holds exactly one,
    and starts where the run of local characters before it starts (or where the match before ended)."""
    out, free, at = [], 0, text.find("@")
    local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in local:
            s -= 1
        if s < at and (m := _EMAIL.match(text, s)):
            out.append((s, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def features(word: str, before: str, after: str, cue: bool = False) -> list[int]:
    """Numbers of the features that hold: shape, lengths and what stands beside the word."""
    digits = _digits(word)
    letters = sum(c.isalpha() for c in word)
    dots, dashes = word.count("."), word.count("-")
    out = [0, 1 + min(digits, 20), 22 + min(letters, 5), 28 + min(dots, 5), 34 + min(dashes, 4)]
    out.append(39 + ("@" in word[1:-1]))
    out.append(41 + word.startswith("+"))
    out.append(43 + (word.startswith("(") or word.endswith(")")))
    out.append(45 + (digits > 0 and letters > 0))
    out.append(47 + bool(_DIGIT.match(word)))
    out.append(49 + (2 if _DIGIT.search(before) else 1 if before.startswith("+") else 0))
    out.append(52 + bool(_DIGIT.search(after)))
    parts = word.split(".")
    out.append(54 + (len(parts) == 4 and all(0 < len(p) < 4 and _digits(p) == len(p) and int(p) < 256 for p in parts)))
    out.append(56 + cue)
    out.append(58 + mixed(word))
    return out


N_FEATURES = 60


def mixed(word: str) -> bool:
    """Whether a word looks like a key: 16 characters or more, with digits and letters, no blanks or @."""
    return len(word) >= 16 and 0 < _digits(word) < len(word) and "@" not in word and any(c.isalpha() for c in word)


def nodes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, core) of the active words, stripped of punctuation around them."""
    out = []
    for m in _ACTIVE.finditer(text):
        word = m[0]
        start, end = _OPEN.match(word).end(), len(word)
        while end > start and word[end - 1] not in _ALNUM:
            end -= 1
        if end > start:
            out.append((m.start() + start, m.start() + end, word[start:end]))
    return out


def cued(text: str, start: int) -> bool:
    """Whether a cue of a secret stands right before a position."""
    return bool(_CUE.search(text, max(0, start - _CUE_REACH), start))


def _skip_keys(core: str) -> tuple[str, str]:
    return core.lower(), re.sub(r"[^0-9]", "", core)


def chained(found: list[tuple[int, int, str]], i: int) -> bool:
    """Whether a chain edge joins node i to the one before."""
    return i > 0 and found[i][0] - found[i - 1][1] <= CHAIN_GAP


def skip_edges(found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Each node with the first node of equal core, or of equal digits (four at least), if no chain edge joins them."""
    first: dict[str, int] = {}
    out = []
    for i, (_, _, core) in enumerate(found):
        a, d = _skip_keys(core)
        j = first.get("a" + a, first.get("d" + d) if len(d) >= 4 else None)
        if j is not None and not (j == i - 1 and chained(found, i)):
            out.append((j, i))
        first.setdefault("a" + a, i)
        if len(d) >= 4:
            first.setdefault("d" + d, i)
    return out


class Field:
    """weights: N_FEATURES x labels; chain and skip: labels x labels log-potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, text: str, found: list[tuple[int, int, str]], pinned: list[int | None]) -> np.ndarray:
        n, k = len(found), len(LABELS)
        unary = np.zeros((n, k))
        for i, (_, _, core) in enumerate(found):
            cue = cued(text, found[i][0])
            unary[i] = self.weights[features(core, found[i - 1][2] if i else "", found[i + 1][2] if i + 1 < n else "", cue)].sum(axis=0)
            if pinned[i] is not None:
                unary[i] = -50.0
                unary[i, pinned[i]] = 0.0
        edges = [(i, i + 1, self.chain) for i in range(n - 1) if chained(found, i + 1)]
        edges += [(a, b, self.skip) for a, b in skip_edges(found)]
        if not edges:
            return _softmax(unary)
        a = np.array([e[0] for e in edges])
        b = np.array([e[1] for e in edges])
        pot = np.array([e[2] for e in edges])
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        pots = np.concatenate((pot, pot.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        msg = np.zeros((len(src), k))
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            new = out[:, :, None] + pots
            top = new.max(axis=1, keepdims=True)
            new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - msg).max() < 1e-3:
                msg = new
                break
            msg = 0.5 * msg + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pin(found: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[int | None]:
    """The base label of each node that overlaps a base span."""
    out: list[int | None] = [None] * len(found)
    j = 0
    for i, (s, e, _) in enumerate(found):
        while j < len(spans) and spans[j][2] <= s:
            j += 1
        for t in range(j, min(len(spans), j + 4)):
            if spans[t][0] < e and spans[t][2] > s:
                out[i] = spans[t][1] + 1
                break
    return out


#: An added span has at least this many digits; an address has an @ inside, a secret looks like a key.
_LEAST_DIGITS = (0, 4, 12, 7, 1)


def _plausible(kind: int, core: str) -> bool:
    return _digits(core) >= _LEAST_DIGITS[kind] and (kind != 0 or "@" in core[1:-1]) and (kind != SECRET - 1 or mixed(core))


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """(base spans, all spans) as (start, kind number, end)."""
    text = text or ""
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text):
        return base, base
    found = nodes(text)
    if not found:
        return base, base
    pinned = _pin(found, base)
    if all(p is not None for p in pinned):
        return base, base
    p = field.marginals(text, found, pinned)
    added = []
    for i, (s, e, _) in enumerate(found):
        k = int(p[i].argmax())
        if pinned[i] is None and k and p[i, k] >= SURE and _plausible(k - 1, found[i][2]):
            added.append((s, k - 1, e))
    return base, sorted(base + added)


_EXAMPLE_DDL = "label int, before string, core string, after string, cue boolean, prior int, place long"


def example_labels(text: str, found: list[tuple[int, int, str]]) -> list[int]:
    """Training labels: those of the patterns, and secret for a long mixed word that stands after a cue anywhere in the text."""
    out = [x or 0 for x in _pin(found, base_spans(text))]
    told = {core for s, _, core in found if mixed(core) and cued(text, s)}
    return [SECRET if not x and core in told else x for x, (_, _, core) in zip(out, found, strict=True)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Active words (id hash, text) with their label; prior: 10 * kind of edge (1 chain, 2 skip) + the label at its other end;
    place: a number that follows from the document's and the word's place in it."""
    types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
    for b in slices(batches, 1):
        rows = []
        for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = t.as_py() or ""
            found = nodes(text)
            labels = example_labels(text, found)
            skip = dict((j, i) for i, j in skip_edges(found))
            for i, (s, _, core) in enumerate(found):
                edge = 20 + labels[skip[i]] if i in skip else 10 + labels[i - 1] if chained(found, i) else -1
                place = ((h ^ (i * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 >> 7) & ((1 << 62) - 1)
                rows.append((labels[i], found[i - 1][2] if i else "", core, found[i + 1][2] if i + 1 < len(found) else "", cued(text, s), edge, place))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _EXAMPLE_DDL.split(", ")])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field learned from a bounded sample of documents, the same on every run."""
    k = len(LABELS)
    sample = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = sample.count()
    # 40 bits of the hash: fine enough for the share of any number of documents
    place = F.pmod("h", F.lit(1 << 20)) * (1 << 20) + F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 20))
    part = sample.filter(place < int((1 << 40) * min(1.0, TRAIN_DOCS / max(1, n))))
    rows = part.select("h", "text").mapInArrow(_examples, _EXAMPLE_DDL).orderBy("place", "core", "before", "after", "label", "prior").limit(TRAIN_WORDS).collect()
    if not rows:
        return Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    x = np.zeros((len(rows), N_FEATURES))
    for i, r in enumerate(rows):
        x[i, features(r["core"], r["before"], r["after"], r["cue"])] = 1
    y = np.eye(k)[[r["label"] for r in rows]]
    w = np.zeros((N_FEATURES, k))
    rate, speed = 4.0 / len(rows), np.zeros_like(w)
    for _ in range(300):
        grad = x.T @ (_softmax(x @ w) - y) + 0.05 * w
        speed = 0.9 * speed - rate * grad / 4
        w = w + speed
    pots = []
    for kind in (1, 2):
        c = Counter((r["prior"] % 10, r["label"]) for r in rows if r["prior"] // 10 == kind)
        joint = np.full((k, k), 0.5)
        for (a, b), m in c.items():
            joint[a, b] += m
            joint[b, a] += m
        joint /= joint.sum()
        side = joint.sum(axis=1)
        pots.append(np.clip(np.log(joint / np.outer(side, side)), -3, 3))
    return Field(w, *pots)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans): the first four counts are of base
    spans, n_secret is that of added secrets, n_spans that of all spans."""
    parts = field.weights, field.chain, field.skip
    ddl = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_secret long, n_spans long"

    def joined(spans: list) -> str:
        return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*parts)
        for b in slices(batches, 1):
            found = [all_spans(t.as_py(), f) for t in b.column(1)]
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found], pa.string()), pa.array([joined(x) for _, x in found], pa.string()),
                 pa.array([sum(s[1] == SECRET - 1 for s in x) for _, x in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs))
