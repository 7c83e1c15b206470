"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the symbols of a text: *insult* (a learned lexicon of words
and word stems with weights), *threat* (intent, a verb of violence, a target),
*target* (who is addressed), *negation* (in force for ``SCOPE`` words) and
*reported speech* (the rest of a clause after a verb of saying, one more after a
colon, and quotations up to their end or the end of the paragraph).  Each is a
table (state, symbol) -> state; ``compose`` runs them as one machine whose states
are tuples.  An insult's weight goes to its clause under the machine's state; at
the clause's end the clause emits its sum, multiplied by ``AIMED`` if someone is
addressed, ``NEGATED`` or ``REPORTED`` where that holds.  A stem that clean texts
hold now and then emits nothing before its second match.

A document's score is logistic in what its matched clauses emit and in what a clean
text of its length would emit by chance; threats are joined to it as independent
evidence with fixed strengths.

Training reads only labelled rows whose crc32(id as text) mod 3 is not 1, at most
``TRAIN_ROWS`` of them, those of the smallest hash; near-equal texts count once.
Patterns get log-odds weights from document counts at the lower end of their
confidence; the score is fitted on emissions of lexicons learned on the other half
of the sample.  labels, lang, source and id are no inputs of a score.

Defined results: null and empty texts get the score of a text without any pattern;
no labels give an empty lexicon and a score below 0.5 for everything but threats;
a document labelled twice is toxic if any label says so; rows with a null id are
scored and are never held out nor learned from; repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm.batches import slices
from lodestone.llm.decontam import shingles_of, words_of

TRAIN_ROWS = 20_000
TRAIN_PARTS = 32  # the sample is small in bytes, so that adaptive plans would leave it to one task
CUTOFF = 0.7
MIN_DOCS = 5
MIN_LIFT = 2.0  # lower end of a pattern's log-odds
SURE = 1.64  # standard deviations below the estimate
STEMS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: Words, clause ends, quotation marks; a straight mark after a digit is an inch or second mark.
_PIECE = re.compile(r"[^\W\d_]+|\n+|:|[.!?;]+|(?<![0-9])\"|[“”«»„]")
# Function words and verbs of the four languages, by transducer.
TARGET = frozenset("you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch sie er tu te toi ton ta tes vous votre vos il elle ils tú ti tus usted ustedes vosotros él ella ellos".split())
NEGATION = frozenset("not never no nobody none without cannot isn aren wasn don doesn didn nicht nie kein keine keiner niemals pas jamais aucun aucune rien nunca jamás ningún ninguna nadie".split())
REPORTED_BY = frozenset("said says saying told tells quoted quote wrote reported claimed alleged sagte sagt schrieb zitierte behauptete dit disait écrit affirme dijo dice escribió afirmó".split())
THREAT = frozenset("kill murder stab strangle shoot behead lynch töten umbringen erschießen erstechen tuer assassiner égorger matar asesinar apuñalar".split())
INTENT = frozenset("will going gonna shall must werde wirst wird vais va voy vas".split())
SCOPE = 4  # words that a negation reaches
AIMED, NEGATED, REPORTED = 1.5, 0.1, 0.1  # multipliers of a clause's weight
FULL_THREAT, HALF_THREAT = 0.8, 0.15  # probabilities
PRIOR, PRIOR_BIAS = np.array([1.6, -1.0]), -3.0  # of log(1 + emitted) and log(1 + emitted by chance)

SYMBOLS = ("word", "insult", "threat", "target", "negation", "report", "intent", "quote", "colon", "end", "paragraph")
_WORDS = ("word", "insult", "threat", "target", "negation", "report", "intent")
_ENDS = ("colon", "end", "paragraph")


def _table(states: int, rules: dict[tuple[int, str], int]) -> list[dict[str, int]]:
    """A transition table: a symbol without a rule leaves the state as it is."""
    return [{y: rules.get((s, y), s) for y in SYMBOLS} for s in range(states)]


def _target() -> list[dict[str, int]]:
    """0 nobody, 1 somebody is addressed in this clause."""
    return _table(2, {(0, "target"): 1} | {(1, e): 0 for e in _ENDS})


def _negation() -> list[dict[str, int]]:
    """The number of words that a negation still reaches."""
    rules = {(s, y): max(0, s - 1) for s in range(SCOPE + 1) for y in _WORDS}
    rules |= {(s, "negation"): SCOPE for s in range(SCOPE + 1)} | {(s, e): 0 for s in range(SCOPE + 1) for e in _ENDS}
    return _table(SCOPE + 1, rules)


def _report() -> list[dict[str, int]]:
    """0 own words, 1 reported, 2 reported after a colon, 3 quoted."""
    rules = {(s, "report"): 1 for s in (0, 1, 2)} | {(s, "quote"): 3 for s in (0, 1, 2)} | {(3, "quote"): 0}
    rules |= {(1, "colon"): 2, (1, "end"): 0, (2, "end"): 0} | {(s, "paragraph"): 0 for s in (1, 2, 3)}
    return _table(4, rules)


def _threat() -> list[dict[str, int]]:
    """0 nothing, 1 intent, 2 a verb of violence, 3 intent and verb, 4 both and a target; none reaches over a quotation mark."""
    rules = {(0, "intent"): 1, (0, "threat"): 2, (1, "threat"): 3, (3, "target"): 4} | {(s, e): 0 for s in range(5) for e in (*_ENDS, "quote")}
    return _table(5, rules)


def _insult() -> list[dict[str, int]]:
    """0 no insult in this clause, 1 at least one."""
    return _table(2, {(0, "insult"): 1} | {(1, e): 0 for e in _ENDS})


def compose(*machines: list[dict[str, int]]) -> tuple[list[tuple[int, ...]], list[dict[str, int]]]:
    """The states that the machines reach together, and the table of their steps."""
    states, number, table = [(0,) * len(machines)], {(0,) * len(machines): 0}, []
    for now in states:  # grows while new tuples are found
        row = {}
        for y in SYMBOLS:
            to = tuple(m[s][y] for m, s in zip(machines, now, strict=True))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row[y] = number[to]
        table.append(row)
    return states, table


_STATES, _STEPS = compose(_insult(), _target(), _negation(), _report(), _threat())
_HELD = [s[0] == 1 for s in _STATES]
_FACTOR = [(NEGATED if s[2] else 1.0) * (REPORTED if s[3] else 1.0) for s in _STATES]
_CLAUSE = [AIMED if s[1] else 1.0 for s in _STATES]
_DANGER = [0 if s[2] or s[3] else 2 if s[4] == 4 else 1 if s[4] in (2, 3) else 0 for s in _STATES]


class Grammar:
    """The composed machine with a learned insult lexicon {pattern: weight}.
    A stem ends in ``*``; a pattern after ``2:`` emits from its second match on."""

    def __init__(self, lexicon: dict[str, float]):
        self.patterns = {(k[2:] if k.startswith("2:") else k): (v, k.startswith("2:")) for k, v in lexicon.items()}
        self._memo: dict[str, tuple[float, str | None]] = {}

    def weight(self, word: str) -> tuple[float, str | None]:
        """(weight, the pattern that must match twice or None) of the strongest pattern of a word."""
        got = self._memo.get(word)
        if got is None:
            got = (0.0, None)
            for p in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
                if p in self.patterns and self.patterns[p][0] > got[0]:
                    got = (self.patterns[p][0], p if self.patterns[p][1] else None)
            if len(self._memo) > 400_000:
                self._memo.clear()
            self._memo[word] = got
        return got

    def emissions(self, text: str | None) -> tuple[float, int, int, int]:
        """(weight that the clauses emit, full threats, half threats, words) of the whole text."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        memo, weight = self._memo, self.weight
        kinds = set(words)
        if not any((memo.get(w) or weight(w))[0] for w in kinds) and THREAT.isdisjoint(kinds):
            return 0.0, 0, 0, len(words)
        state, total, clause = 0, 0.0, 0.0
        danger, threats = 0, [0, 0, 0]
        hits: dict[str, int] = {}
        for piece in _PIECE.findall(low):
            first = piece[0]
            if first.isalpha():
                w, twice = weight(piece)
                if w and twice:  # nothing at the first match, at the second for both
                    seen = hits[twice] = hits.get(twice, 0) + 1
                    w = 0.0 if seen == 1 else 2 * w if seen == 2 else w
                if w:
                    clause += w * _FACTOR[state]
                    symbol = "insult"
                else:
                    symbol = "threat" if piece in THREAT else "target" if piece in TARGET else "negation" if piece in NEGATION else "report" if piece in REPORTED_BY else "intent" if piece in INTENT else "word"
            else:
                symbol = "paragraph" if first == "\n" else "colon" if first == ":" else "quote" if first in '"“”«»„' else "end"
                if symbol != "quote":
                    if _HELD[state]:
                        total += clause * _CLAUSE[state]
                        clause = 0.0
                    threats[danger] += 1
                    danger = 0
            state = _STEPS[state][symbol]
            if _DANGER[state] > danger:
                danger = _DANGER[state]
        if _HELD[state]:
            total += clause * _CLAUSE[state]
        threats[danger] += 1
        return total, threats[2], threats[1], len(words)


def _lexicon(rows: list, pos: str, neg: str, n_pos: float, n_neg: float) -> dict[str, float]:
    """Patterns whose log-odds are surely above MIN_LIFT, for one match or (``2:``) two, whichever says more."""
    out = {}
    for r in rows:
        best = (0.0, "")
        for level, mark in (("1", ""), ("2", "2:")):
            p, n = r[pos + level], r[neg + level]
            if p < MIN_DOCS:
                continue
            odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((n + 0.5) / (n_neg + 1))
            low = odds - SURE * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
            if low >= MIN_LIFT and low > best[0]:
                best = (float(low), mark)
        if best[0]:
            out[best[1] + r["pattern"]] = best[0]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> tuple[np.ndarray, float]:
    """Maximum a posteriori weights around PRIOR, of PRIOR's signs, and the bias, by Newton steps."""
    z = np.column_stack((x, np.ones(len(x))))
    centre = np.append(PRIOR, PRIOR_BIAS)
    pull = np.append(np.full(len(PRIOR), strength), 0.01)
    b = centre.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (p - y) + pull * (b - centre)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        b[0], b[1] = max(b[0], 0), min(b[1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


class Model:
    """chance: the weight that clean texts emit for each word."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, bias: float, chance: float):
        self.lexicon, self.weights, self.bias, self.chance = lexicon, weights, bias, chance

    def scorer(self):
        g, (own, by_chance), b, chance = Grammar(self.lexicon), self.weights, self.bias, self.chance

        def score(text: str | None) -> float:
            emitted, full, half, words = g.emissions(text)
            logit = own * np.log1p(emitted) + by_chance * np.log1p(chance * words) + b
            calm = (1 - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) * (1 - FULL_THREAT) ** full * (1 - HALF_THREAT) ** min(half, 2)
            return float(1 - calm)

        return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    sample = sample.filter(F.crc32(F.col("id").cast("string")) % 3 != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").withColumn("words", words_of(F.col("text")))  # TRAIN_ROWS rows at most
    rows = rows.select("id", "toxic", "text", F.coalesce(F.array_min(shingles_of(F.col("words"))), F.xxhash64("id")).alias("twin"))
    rows = scratch.table(rows.repartition(TRAIN_PARTS, "twin").groupBy("twin").agg(F.min_by(F.struct("id", "toxic", "text"), "id").alias("r")).select("r.*", (F.abs(F.xxhash64(F.col("r.id"))) % 2).alias("half")), "sample")
    kinds = [f"{side}{half}{level}" for half in (0, 1) for side in "pn" for level in (1, 2)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}  # documents with a pattern once and twice, by label and half; bounded by the sample
        for b in batches:
            for half, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = Counter()
                for w, n in Counter(_WORD.findall((text or "").lower())).items():
                    found[w] += n
                    for k in STEMS:
                        if len(w) > k:
                            found[w[:k] + "*"] += n
                at = 4 * half + (0 if toxic else 2)
                for pattern, n in found.items():
                    c = held.setdefault(pattern, [0] * 8)
                    c[at] += 1
                    c[at + 1] += n > 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([c[i] for c in held.values()], pa.int64()) for i in range(8))], names=["pattern", *kinds])

    counts = rows.select("half", "toxic", "text").mapInArrow(seen, "pattern string, " + ", ".join(f"{k} long" for k in kinds))
    counts = counts.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in kinds])
    n = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    total = lambda t: n.get((t, 0), 0) + n.get((t, 1), 0)
    counts = counts.withColumns({f"{s}{level}": F.col(f"{s}0{level}") + F.col(f"{s}1{level}") for s in "pn" for level in (1, 2)})
    # bounded by the sample: patterns in MIN_DOCS toxic documents that are clearly rarer in the others
    rare = lambda v: (F.col(f"p{v}") >= MIN_DOCS) & ((F.col(f"p{v}") + 0.5) * (total(0) + 1) > 4.0 * (F.col(f"n{v}") + 0.5) * (total(1) + 1))
    found = counts.filter(rare(1) | rare(2)).collect()
    whole = _lexicon(found, "p", "n", total(1), total(0))
    halves = [_lexicon(found, f"p{h}", f"n{h}", n.get((1, h), 0), n.get((0, h), 0)) for h in (0, 1)]

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Grammar(x) for x in halves]
        for b in batches:
            e = [machines[1 - h].emissions(t) for h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in e], pa.float64()), pa.array([x[3] for x in e], pa.int64())], names=["toxic", "emitted", "words"])

    got = rows.select("half", "toxic", "text").mapInArrow(emitted, "toxic int, emitted double, words long").orderBy("words", "emitted", "toxic").collect()  # TRAIN_ROWS rows at most
    if not got:
        return Model(whole, PRIOR, PRIOR_BIAS, 0.0)
    e, words, toxic = (np.array([r[c] for r in got], float) for c in ("emitted", "words", "toxic"))
    chance = float(e[toxic == 0].sum() / max(1.0, words[toxic == 0].sum()))
    weights, bias = fit_logistic(np.column_stack((np.log1p(e), np.log1p(chance * words))), toxic)
    return Model(whole, weights, bias, chance)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, held_out, score, predicted."""
    parts = model.lexicon, model.weights, model.bias, model.chance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*parts).scorer()
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the toxic ones; columns and types stay."""
    parts = model.lexicon, model.weights, model.bias, model.chance
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Model(*parts).scorer()
        for b in slices(batches, at):
            yield b.filter(pa.array([score(t.as_py()) < CUTOFF for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
