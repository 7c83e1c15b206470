"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (fewer words: one shingle of
all of them).  The weight axis is cut into unit steps grouped in dyadic blocks
[0,1), [1,2), [2,4), ...: each (shingle, block) drives one Poisson process whose
points, in ascending order, fall on a register and on a unit step; points on
steps above the shingle's weight are thinned out, so two documents see the same
points where both weights reach.  A process stops once its next point is above
the largest register of its document.  The least point of each register is the
signature; two signatures agree in a register with a probability that is the
weighted Jaccard similarity.

Documents with equal words are one text, represented by the least id.  Texts that
agree in a whole band of registers meet in a bucket.  In every bucket all are
compared with its centre, the text with the most company over all its buckets (a
star, not all pairs), by exact multiset overlap of
their texts; links of at least ``THRESHOLD`` give components.  Where a bucket
still holds several components, the members outside its largest one are compared
with those of other components, so that no link between components is lost.  A
pair goes into that comparison if the parities of its shingle counts in 1,024 cells
differ in no more cells than the counts of a similar pair can (this drops no
similar pair: the counts differ by at least the number of such cells); nothing is
capped.

Defined results: null or wordless texts are similar to nothing and keep their own
class; rows with a null id get a null class and take no part; repeated rows and
ids share a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._names import fresh
from lodestone.llm._text import MULT_A, MULT_B, U, Words, mix, windows
from lodestone.llm.batches import slices
from lodestone.operators.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 8  # a pair of similarity 0.8 shares no band with probability 6e-4, of 0.85 3e-6
PARITY = 16  # 64-bit integers of parities
SLICE = 1 << 18  # bytes of text at once: a worker's arrays are some hundred times as large
_GOLD = U(0x9E3779B97F4A7C15)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of every row."""
    h = w.hashes(MULT_A)
    at, r = windows(w, k, h)
    row = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = np.array([mix(np.add.reduce(h[w.first[i] : w.first[i + 1]] * (np.arange(1, w.count[i] + 1).astype(U) * MULT_B + _GOLD)).reshape(1))[0] for i in short], dtype=U)
        row, r = np.concatenate((row, short)), np.concatenate((r, extra))
    return row, r


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    return row[start], h[start], np.diff(np.append(start, len(row)))


def bag_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m registers (float64); rows without shingles stay at infinity."""
    regs = np.full(n * m, np.inf)
    owner, seed, low, length, cap = [row], [h], [np.zeros(len(row))], [np.ones(len(row))], [weight]
    base = 1
    while True:
        on = np.flatnonzero(weight > base)
        if not len(on):
            break
        owner.append(row[on])
        with np.errstate(over="ignore"):
            seed.append(mix(h[on] ^ (U(base) * MULT_B)))
        low.append(np.full(len(on), float(base)))
        length.append(np.full(len(on), float(base)))
        cap.append(weight[on])
        base *= 2
    owner, seed, low, length, cap = map(np.concatenate, (owner, seed, low, length, cap))
    x = np.zeros(len(owner))
    rate = 1.0 / (m * length)
    step = 0
    while len(owner):
        with np.errstate(over="ignore"):
            seed = seed + _GOLD
            a = mix(seed)
            c = mix(a ^ MULT_B)
        x = x - np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        at = owner * m + (c % U(m)).astype(np.int64)
        level = low + np.floor((c >> U(40)).astype(np.float64) * 2.0**-24 * length)
        ok = level < cap
        np.minimum.at(regs, at[ok], x[ok])
        step += 1
        if step < 4 or step % 4 == 0:
            top = regs.reshape(n, m).max(axis=1)
            live = x < top[owner]
            owner, seed, low, length, cap, x, rate = (v[live] for v in (owner, seed, low, length, cap, x, rate))
    return regs.reshape(n, m)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different for different bands."""
    bits = signature[:, : bands * rows].copy().view(U).reshape(len(signature), bands, rows)
    out = np.zeros(bits.shape[:2], dtype=U) + np.arange(1, bands + 1, dtype=U)[None, :]
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * MULT_A + bits[:, :, k])
    return out


def parity_of(row: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n rows of PARITY integers: whether the counts of the shingles of each cell add up to an odd number."""
    odd = np.flatnonzero(count & 1)
    cell = mix(h[odd] ^ _GOLD) >> U(64 - (PARITY * 64 - 1).bit_length())
    out = np.zeros(n * PARITY, dtype=U)
    np.bitwise_xor.at(out, row[odd] * PARITY + (cell >> U(6)).astype(np.int64), U(1) << (cell & U(63)))
    return out.reshape(n, PARITY)


def _may_reach(threshold: float):
    """Whether the counts of a pair (size, parity: na, pa and nb, pb) can be similar enough: their difference D and sum S have (S - D) / (S + D) >= threshold."""
    cells = F.lit(0)
    for k in range(PARITY):
        cells = cells + F.bit_count(F.get(F.col("pa"), F.lit(k)).bitwiseXOR(F.get(F.col("pb"), F.lit(k))))
    return F.greatest(cells, F.abs(F.col("na") - F.col("nb"))) <= (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


_SIG_DDL = "id long, k1 long, k2 long, size int, bands array<long>, parity array<long>"


def signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """id, two 64-bit hashes of all words, band keys; rows without words or id are left out."""
    for b in slices(batches, 1, SLICE):
        b = b.filter(pa.compute.is_valid(b.column(0)))
        w = Words(b.column(1))
        has = np.flatnonzero(w.count > 0)
        if not len(has):
            continue
        row, h, n = counted(*shingles(w))
        signature = bag_minhash(row, h, n, w.n, bands * rows)[has]
        keys, parity = bands_of(signature, bands, rows), parity_of(row, h, n, w.n)[has]
        size = np.bincount(row, n, w.n)[has].astype(np.int32)
        with np.errstate(over="ignore"):
            place = (np.arange(len(w)) - w.first[w.doc] + 1).astype(U)
            k1 = np.add.reduceat(mix(w.hashes(MULT_A) + place * MULT_B), w.first[has])
            k2 = np.add.reduceat(mix(w.hashes(MULT_B) ^ (place * _GOLD)), w.first[has])
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1).view(np.int64))) for x in (keys, parity)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size), *lists], names=["id", "k1", "k2", "size", "bands", "parity"])


def _similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    ra, ha = shingles(Words(a))
    rb, hb = shingles(Words(b))
    row, h = np.concatenate((ra, rb)), np.concatenate((ha, hb))
    left = np.concatenate((np.ones(len(ra)), np.zeros(len(rb))))
    order = np.lexsort((h, row))
    row, h, left = row[order], h[order], left[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    total = np.diff(np.append(start, len(row)))
    ca = np.add.reduceat(left, start) if len(start) else np.zeros(0)
    both = np.minimum(ca, total - ca)
    either = np.maximum(ca, total - ca)
    n = len(a)
    s, t = np.bincount(row[start], both, n), np.bincount(row[start], either, n)
    return s / np.maximum(t, 1)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the pairs (a, b) whose texts are similar enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, 2, SLICE):
            ok = _similarities(s.column(2), s.column(3)) >= threshold
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1)], names=["u", "v"]).filter(pa.array(ok))

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(keep, "u long, v long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id): the class is the least id of the document's component."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = scratch.table(plain.mapInArrow(lambda it: signatures(it, bands, rows), _SIG_DDL), "signatures")
    least = made.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    member = scratch.table(made.select("id", "k1", "k2").join(least, ["k1", "k2"]).select("id", "rep").distinct(), "members")
    # every id of a text has its bands: those of the least id stand for it
    own = made.join(member.filter(F.col("id") == F.col("rep")).select("id"), "id", "left_semi")
    rowed = own.select(F.col("id").alias("rep"), F.explode("bands").alias("bucket")).distinct()
    many = rowed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    bucket = scratch.table(rowed.join(many, "bucket"), "buckets")
    company = bucket.join(bucket.groupBy("rep").agg(F.sum("n").alias("company")), "rep")
    centre = company.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("c"))).alias("m")).select("bucket", (-F.col("m.c")).alias("centre"))
    bucket_centre = bucket.select("bucket", "rep").join(centre, "bucket")
    counts = own.select("id", "size", "parity").dropDuplicates(["id"])
    # representatives only; an id may stand on several rows: one text of it is enough, as they share the id
    star = scratch.table(bucket_centre.filter(F.col("rep") != F.col("centre")).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    used = bucket.select(F.col("rep").alias("id")).distinct()
    texts = scratch.table(plain.join(used, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    links = scratch.table(_verified(star, texts, threshold), "links")
    first = connected_components(links, scratch)
    placed = scratch.table(bucket.select("bucket", "rep").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    parts = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("bucket", "largest")
    placed = placed.join(mixed, "bucket").join(counts.withColumnRenamed("id", "rep"), "rep")
    outside = placed.filter(F.col("c") != F.col("largest")).select("bucket", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("size").alias("na"), F.col("parity").alias("pa"))
    inside = placed.select(F.col("bucket").alias("bucket_b"), F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("size").alias("nb"), F.col("parity").alias("pb"), (F.col("c") == F.col("largest")).alias("main"))
    cross = outside.join(inside, (F.col("bucket") == F.col("bucket_b")) & (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") > F.col("b"))) & _may_reach(threshold)).select("a", "b").distinct()
    known = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = scratch.table(_verified(cross.join(known, ["a", "b"], "left_anti"), texts, threshold), "links")
    whole = links if more.isEmpty() else links.union(more)
    final = first if whole is links else connected_components(whole, scratch)
    scratch.drop(texts, placed, made)
    by_id = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    by_id = by_id.groupBy("id").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(by_id, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class, whether it is the one that stays, and the size of its class."""
    c = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = c.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return c.join(size, "class_id", "left").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id, one row of each id; rows with a null id stay."""
    gone_id, again_id, place = fresh(docs.columns, "gone_id", "again_id", "m_place")
    gone = classes(docs, id_col=id_col, text_col=text_col).filter(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias(gone_id)).distinct()
    ident = F.col(id_col).cast("long")
    left = docs.join(gone, ident == F.col(gone_id), "left_anti").select(*docs.columns)
    again = docs.groupBy(ident.alias(again_id)).agg(F.count(F.lit(1)).alias(place)).filter(F.col(again_id).isNotNull() & (F.col(place) > 1)).select(again_id)
    if again.isEmpty():
        return left
    first = Window.partitionBy(ident).orderBy(text_col)
    one = left.join(again, ident == F.col(again_id), "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
    return left.join(again, ident == F.col(again_id), "left_anti").unionByName(one)
