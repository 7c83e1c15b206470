"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Words are those of the lower-cased text.  Each benchmark item and each item-sized
window of a document has a 64-bit SimHash of its words.  A fingerprint is cut into
six blocks of 11 or 10 bits; two fingerprints at most ``RADIUS`` = 23 bits apart differ in
at most three bits in one of them, so looking up every item block with up to three
bits flipped finds all item fingerprints within the radius.  Candidates are then
compared exactly: weighted Jaccard similarity of the five-word shingle multisets
of window and item, at least ``THRESHOLD``.

The union of a window's and an item's shingles is no smaller than the item's, so a
window that passes has at least ``THRESHOLD`` times as many places with a shingle of
the item as the item has shingles.  All windows that do are fingerprinted, at every
start, whatever the order of the item's parts: this loses no pair that the exact
comparison would accept.  The radius may still lose one (figures in the README).

Everything on the main path is a DataFrame expression.  Item tables are broadcast
only below ``BROADCAST_ROWS`` counted rows; beyond it they are shuffled.

Defined results: null or wordless texts and items match nothing; items under five
words are one shingle; windows are clipped at the ends of a document; rows with a
null id are searched and reported with a null id; repeated documents give a row
each per item; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._names import fresh

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits of the blocks of a fingerprint, lowest first
FLIPS = 3
RADIUS = (FLIPS + 1) * len(BLOCKS) - 1
BROADCAST_ROWS = 1_000_000
_MASKS = [sum(1 << k for k in c) for n in range(FLIPS + 1) for c in combinations(range(max(BLOCKS)), n)]
_WS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text; no words for null."""
    ends = F.regexp_replace(F.lower(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(ends) > 0, F.split(ends, _WS)).otherwise(F.array().cast("array<string>"))


def shingles_of(words: Column) -> Column:
    """Hashes of the five-word shingles, in order; of fewer words, one of all.
    words must be a column of the row, not an expression: it is read at every position."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a column of word hashes: bit b is set if more than half of them have it."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1),
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, n: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(n > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def _hashed(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _block(code: Column, k: Column) -> Column:
    """The k-th block of a fingerprint."""
    shift, mask = F.lit(0), F.lit(0)
    for i, width in enumerate(BLOCKS):
        shift = F.when(k == i, sum(BLOCKS[:i])).otherwise(shift)
        mask = F.when(k == i, (1 << width) - 1).otherwise(mask)
    return F.call_function("shiftrightunsigned", code, shift).bitwiseAND(mask).cast("int")


def _overlap(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of shingle hashes."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item, start, similarity): for each document and item, the best window."""
    item = items.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    item = item.withColumn("item_words", F.size("words")).withColumn("item_shingles", shingles_of(F.col("words")))
    n_shingles, n_items = item.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)), F.count(F.lit(1))).first()
    item = item.withColumn("hashes", _hashed("words")).withColumn("item_code", simhash(F.col("hashes"))).drop("words", "hashes")
    # explode_outer: a plain explode adds a filter on its array below the projection, which computes the array again
    # the places in a document that hold a shingle of an item
    anchors = item.select("item", "item_words", F.size("item_shingles").alias("n"), F.explode_outer(F.array_distinct("item_shingles")).alias("shingle"))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = plain.select("id", words_of(F.col("text")).alias("words")).select("id", shingles_of(F.col("words")).alias("shingles")).select("id", F.posexplode_outer("shingles").alias("at", "shingle"))
    hit = held.join(_small(anchors, n_shingles), "shingle").groupBy("id", "item", "item_words", "n").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # a window of n shingles holds the k places from the i-th on if it starts between ats[i + k - 1] - n + 1 and ats[i]
    hit = hit.withColumn("k", F.greatest(F.lit(1), F.ceil(F.lit(float(threshold)) * F.col("n") - F.lit(1e-9)).cast("int"))).filter(F.size("ats") >= F.col("k"))
    window = hit.select("id", "item_words", F.explode_outer(F.expr(
        "array_distinct(flatten(transform(filter(sequence(0, size(ats) - k), i -> ats[i + k - 1] - ats[i] < n), i -> sequence(ats[i + k - 1] - n + 1, ats[i]))))"
    )).alias("start")).filter(F.col("start").isNotNull())
    # one row for each document, so that its text is read once; ids may repeat or be null
    wanted = window.groupBy("id").agg(F.collect_set(F.struct("start", "item_words")).alias("windows"))
    wanted = wanted.select(F.col("id").alias("wanted_id"), "windows")
    placed = plain.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id"))).select("id", words_of(F.col("text")).alias("words"), "windows")
    cut = placed.select("id", F.explode_outer(F.expr(
        "transform(windows, w -> named_struct('start', w.start, 'item_words', w.item_words, 'words', slice(words, greatest(w.start, 0) + 1, w.item_words + least(w.start, 0))))"
    )).alias("w")).select("id", "w.*").filter(F.size("words") > 0)
    cut = cut.withColumn("hashes", _hashed("words")).withColumn("code", simhash(F.col("hashes"))).withColumn("shingles", shingles_of(F.col("words"))).drop("words", "hashes")
    # multi-index lookup: every item block with up to three bits flipped
    each = F.explode(F.array(*[F.lit(k) for k in range(len(BLOCKS))]))
    masks = F.explode(F.array(*[F.lit(m) for m in _MASKS]))
    index = item.select("item", "item_words", "item_code", each.alias("k")).withColumn("mask", masks)
    index = index.filter(F.col("mask") < F.element_at(F.array(*[F.lit(1 << w) for w in BLOCKS]), F.col("k") + 1))  # the masks of a narrower block
    index = index.select("item", "item_words", "item_code", "k", _block(F.col("item_code"), F.col("k")).bitwiseXOR(F.col("mask")).alias("value"))
    probe = cut.select("id", "start", "item_words", "code", "shingles", each.alias("k")).withColumn("value", _block(F.col("code"), F.col("k")))
    near = probe.join(_small(index, len(BLOCKS) * len(_MASKS) * n_items), ["k", "value", "item_words"]).filter(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= RADIUS)
    near = near.dropDuplicates(["id", "start", "item"]).select("id", "start", "item", "shingles")
    full = near.join(_small(item.select("item", "item_shingles"), n_shingles), "item")
    full = full.withColumn("similarity", _overlap(F.col("shingles"), F.col("item_shingles"))).filter(F.col("similarity") >= threshold)
    best = full.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), (-F.col("m.back")).alias("start"), F.col("m.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **args) -> DataFrame:
    """docs without those that hold an item."""
    (gone_id,) = fresh(docs.columns, "gone_id")
    gone = matches(docs, items, id_col=id_col, **args).select(F.col(id_col).alias(gone_id)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone_id]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
