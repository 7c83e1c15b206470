"""Quality rules with risk-controlled thresholds.

Each rule is a number per document, larger is worse.  Per stratum (language) the
rules share one path of ``GRID`` steps from loose to strict: at step j each rule
cuts at the smallest value of its fixed grid that at most a share ``path()[j]`` of
all the stratum's documents exceeds.  Labels have no part in the path.

Along it hypotheses are tested in a fixed sequence: "the cutoffs of step j reject
more than ``RISK`` of the good documents" is refuted if the exact (Clopper-Pearson)
upper bound of the false rejections of the labelled holdout is at most ``RISK``, at
confidence ``DELTA`` / number of strata.  The last step before the first that is
not refuted is taken.  A fixed sequence needs no further correction, so with
probability 1 - ``DELTA`` all rules together reject at most ``RISK`` of the good
documents of every stratum.  Good documents are holdout documents with quality 1
that pass the base rule.  A stratum with fewer than about ln(strata / DELTA) / RISK
of them (88 for four strata) gets no cutoffs.

Nothing else is fitted, so every labelled document is holdout.  Counts are
aggregated in Spark; the driver sees GRID numbers per stratum and rule.

Defined results: null text has no words and fails the base rule; a null language
is the stratum ``(null)``; documents without a row in labels are judged alike;
repeated rows are judged each; an id that stands several times in documents or
labels is one trial, good if all its labels say so; empty labels leave only the
base rule; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._text import U, Words, mix, windows
from lodestone.llm.batches import slices

RISK = 0.05
DELTA = 0.05
GRID = 48
SHARES = (0.0005, 0.25)  # of a stratum's documents, that one rule cuts at the first and last step
#: rule: (smallest, largest) cutoff of its logarithmic grid.
RULES = {
    "symbol_ratio": (0.02, 3.0),
    "dup_line_ratio": (0.05, 0.95),
    "repeat_ratio": (0.05, 0.95),
    "upper_ratio": (0.02, 0.9),
    "shout_ratio": (0.01, 0.95),
    "word_length": (5.0, 12.0),
    "same_word_ratio": (0.1, 0.98),
}
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout", "n_distinct")
_DDL = "id long, stratum string, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of every document (id, stratum, text)."""
    for b in slices(batches, 2):
        w = Words(b.column(2))
        data, off = w.data, w.offsets
        h = w.hashes()
        n = w.n
        lead = (data & 0xC0) != 0x80  # first bytes of code points
        sums = np.concatenate(([0], np.cumsum(lead)))
        word_chars = np.bincount(w.doc, sums[w.end] - sums[w.start], n).astype(np.int64) if len(w) else np.zeros(n, np.int64)
        at, tri = windows(w, 3, h)
        covered = np.zeros(len(w) + 1, np.int64)
        if len(at):
            key = mix(tri ^ mix(w.doc[at].astype(U)))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            s = at[count[inverse] > 1]
            np.add.at(covered, s, 1)
            np.add.at(covered, s + 3, -1)
        repeat = np.bincount(w.doc[np.cumsum(covered[:-1]) > 0], minlength=n)
        distinct = np.bincount(w.doc[np.unique(mix(h ^ mix(w.doc.astype(U))), return_index=True)[1]], minlength=n) if len(w) else np.zeros(n, np.int64)
        shout = np.bincount(w.doc[data[w.end - 1] == ord("!")], minlength=n) if len(w) else np.zeros(n, np.int64)
        dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, t in enumerate(b.column(2).to_pylist()):
            if t:
                found = [x for x in t.split("\n") if _HAS_WORD.search(x)]
                lines[i], dup[i] = len(found), len(found) - len(set(found))
        values = (w.count, word_chars, _per_row(_SYMBOL[data], off), dup, repeat, lines, _per_row((data >= 65) & (data <= 90), off), shout, distinct)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.asarray(v, np.int64)) for v in values)], names=["id", "stratum", *_COLUMNS])


def rule_values() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "shout_ratio": per("n_shout", "n_words"),
        "word_length": per("word_chars", "n_words"),
        # of documents long enough for it: short texts hardly repeat, long ones must
        "same_word_ratio": F.when(F.col("n_words") >= 50, 1 - per("n_distinct", "n_words")).otherwise(0.0),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still has probability delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        # k or fewer of n at rate p: the tail of beta(k + 1, n - k) above p
        if 1 - _beta_tail(k + 1, n - k, mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def grid(rule: str) -> list[float]:
    lo, hi = RULES[rule]
    return [lo * (hi / lo) ** (i / (GRID - 1)) for i in range(GRID)]


def path() -> list[float]:
    """The share of documents that each rule may cut at each step, from loose to strict."""
    lo, hi = SHARES
    return [lo * (hi / lo) ** (j / (GRID - 1)) for j in range(GRID)]


def paths(measured: DataFrame) -> dict[str, dict[str, list[float]]]:
    """{stratum: {rule: cutoff at each step}} from the measures of all documents."""
    values = rule_values()
    above = [F.sum((values[r] > c).cast("long")).alias(f"{r}:{i}") for r in RULES for i, c in enumerate(grid(r))]
    out = {}
    for row in measured.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above).collect():  # one row per language
        out[row["stratum"]] = {r: [next((c for i, c in enumerate(grid(r)) if row[f"{r}:{i}"] <= q * row["n"]), math.inf) for q in path()] for r in RULES}
    return out


def chosen_step(rejected: list[int], n: int, risk: float, delta: float) -> int:
    """The last step that fixed-sequence testing reaches, -1 for none; rejected: good documents cut at each step, of n."""
    for j, k in enumerate(rejected):
        if k > risk * n or upper_bound(k, n, delta) > risk:
            return j - 1
    return len(rejected) - 1


def _steps_below(value: Column, cuts: list[float]) -> Column:
    """How many of the cutoffs a value does not exceed."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: value <= c))


def cutoffs(measured: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}}; measured: measures of all documents, good: the ids of the good holdout documents."""
    steps = paths(measured)
    values = rule_values()
    first = F.lit(GRID)  # the first step that cuts a document
    for s, rules in steps.items():
        # cutoffs fall from step to step: a document is cut from the step on that follows those it stays below
        at = [_steps_below(values[r], rules[r]) for r in RULES]
        first = F.when(F.col("stratum") == s, F.least(*at)).otherwise(first)
    trials = measured.join(good.distinct(), "id").filter(~F.col("base_failed")).dropDuplicates(["id"])
    counts = trials.groupBy("stratum", first.alias("first")).count().collect()  # GRID + 1 rows per language
    out: dict[str, dict[str, float]] = {}
    for s, rules in steps.items():
        by = {r["first"]: r["count"] for r in counts if r["stratum"] == s}
        rejected = [sum(c for f, c in by.items() if f <= j) for j in range(GRID)]
        j = chosen_step(rejected, sum(by.values()), risk, delta / max(1, len(steps)))
        out[s] = {r: rules[r][j] for r in RULES if math.isfinite(rules[r][j])} if j >= 0 else {}
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures with base_failed, failed (names of failed rules) and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("(null)")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    m = scratch.table(plain.mapInArrow(measures, _DDL), "measures").withColumn("base_failed", base_failed())
    label = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).filter("id IS NOT NULL AND quality IS NOT NULL")
    good = label.groupBy("id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("id")
    chosen = cutoffs(m, good, risk, delta)
    values = rule_values()
    fails = [
        F.when(F.col("stratum").eqNullSafe(s) & (values[r] > c), F.lit(r))
        for s, rules in chosen.items()
        for r, c in rules.items()
    ]
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    out = m.withColumn("failed", F.array_join(failed, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).withColumnRenamed("id", id_col)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    j = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")
