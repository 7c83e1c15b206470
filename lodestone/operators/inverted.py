"""A stored inverted index of q-grams with positions, and search in it with an early end.

A task packs its documents, shortest first, into blocks of at most ``BLOCK_DOCS``; for every
gram of a block there is one row with the documents and the places of the gram, packed as deltas in
seven-bit bytes, and what bounds a score in the block: the most places in a document and the least
length.  One more row of the empty gram has the block's ids and lengths.  A task's rows are a
segment: they are sorted by gram and written where they were made, nothing is shuffled, and a
reader's filter on grams skips row groups of every segment.
Every place of a text has a gram (the last ones are padded), so a pattern of any length is found:
a longer one where grams that cover it stand at the right distances, a shorter one as the start
of grams.  Texts are not read again.

The best hits take two rounds.  The first scores the blocks of the highest bounds until they hold
k candidates; its k-th score lets the second one skip all blocks that are bounded below it.

Defined results: a null text is an empty document; a null id takes no part; repeated ids are
documents of their own; an empty table has no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import qgram
from lodestone.functions.lexical import parse_query

Q = qgram.Q
BLOCK_DOCS, BLOCK_CHARS = 32, 1 << 21
ROW_GROUP = 1 << 20
_PAD = "\0"
_COLUMNS = "gram string, block long, n int, occurrences long, max_tf int, min_len int, packed binary, ids array<long>, lens array<int>"


@dataclass
class Index:
    """Where an index lies, with the number of its documents and their mean length."""

    path: str
    documents: int
    mean: float

    def postings(self, spark) -> DataFrame:
        """(gram, block, n, occurrences, max_tf, min_len, packed): the documents of a block that hold a gram, and its places."""
        return spark.read.schema(_COLUMNS).parquet(f"{self.path}/postings").filter("gram <> ''").drop("ids", "lens")

    def blocks(self, spark) -> DataFrame:
        """(block, n, occurrences, ids, lens): the documents of every block and the characters in them."""
        return spark.read.schema(_COLUMNS).parquet(f"{self.path}/postings").filter("gram = ''").select("block", "n", "occurrences", "ids", "lens")


@dataclass
class Reading:
    """What a search looked at: blocks with a candidate, and those of which postings were read in either round."""

    candidates: int
    first: int
    second: int

    @property
    def skipped(self) -> int:
        return self.candidates - self.first - self.second


def _firsts(counts: np.ndarray) -> np.ndarray:
    """Where the groups of these sizes begin."""
    return np.cumsum(counts) - counts


def _within(counts: np.ndarray) -> np.ndarray:
    """The number of every item within its group."""
    return np.arange(counts.sum()) - np.repeat(_firsts(counts), counts)


def _deltas(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The differences of values, the first of a group as it is."""
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def _sums(deltas: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of ``_deltas`` again; no group is empty."""
    total, first = np.cumsum(deltas), _firsts(counts)
    return total - np.repeat(total[first] - deltas[first], counts)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, with the high bit where more follow; and where each value begins."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    first = _firsts(size)
    out = np.empty(size.sum(), np.uint8)
    at = np.arange(len(values))
    for k in range(5):
        at = at[size[at] > k]
        out[first[at] + k] = (values[at] >> (7 * k)) & 127 | (size[at] > k + 1) << 7
    return out, first


def _from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``_to_bytes`` and where each begins."""
    size = np.diff(np.flatnonzero(data < 128), prepend=-1)
    first = _firsts(size)
    out = np.zeros(len(size), np.int64)
    at = np.arange(len(size))
    for k in range(5):
        at = at[size[at] > k]
        out[at] |= (data[first[at] + k].astype(np.int64) & 127) << (7 * k)
    return out, first


def _unpack(packed: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, number of places) of each document in these rows of n documents, and all places."""
    values, first = _from_bytes(np.frombuffer(b"".join(packed), np.uint8))
    base = np.searchsorted(first, _firsts(np.array([len(p) for p in packed], np.int64)))
    row, k = np.repeat(np.arange(len(n)), n), _within(n)
    doc, tf = _sums(values[base[row] + k], n), values[(base + n)[row] + k]
    held = np.diff(np.append(base, len(values))) - 2 * n
    places = values[np.repeat(base + 2 * n, held) + _within(held)]
    return row, doc, tf, _sums(places, tf)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _block(texts: list[str], ids: list[int], number: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block of texts, which are in lower case and in order of their lengths."""
    lens = np.array([len(t) for t in texts], np.int64)
    n, total = len(texts), int(lens.sum())
    names = ["gram", "block", "n", "occurrences", "max_tf", "min_len", "packed", "ids", "lens"]
    whole = [[""], [number], [n], [total], [0], [int(lens[0])], [None], [ids], [lens.tolist()]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(whole, kinds, strict=True)], names=names)
    if not total:
        return
    points = np.frombuffer("".join(t + _PAD * (Q - 1) for t in texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters, rank = np.flatnonzero(seen), (np.cumsum(seen) - 1)[points]
    doc = np.repeat(np.arange(n), lens)
    at = np.arange(total) + (Q - 1) * doc
    code = reduce(lambda a, k: a * len(letters) + rank[at + k], range(Q), np.zeros(total, np.int64))
    bits = total.bit_length()
    if (len(letters) ** Q).bit_length() + bits < 64:  # code and place in one number: sorted at once
        code = np.sort(code << bits | np.arange(total))
        order, code = code & ((1 << bits) - 1), code >> bits
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    doc = doc[order]
    place = order - _firsts(lens)[doc]  # documents and places stay in order
    new = np.concatenate([[True], code[1:] != code[:-1]])
    g, d = np.flatnonzero(new), np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]]))
    of_gram = np.searchsorted(d, g)  # the first (gram, document) of each gram
    tf, held = np.diff(np.append(d, total)), np.diff(np.append(g, total))
    counts = np.diff(np.append(of_gram, len(d)))
    base = 2 * of_gram + g
    values = np.empty(2 * len(d) + total, np.int64)
    k = np.repeat(base, counts) + _within(counts)
    values[k], values[k + np.repeat(counts, counts)] = _deltas(doc[d], of_gram), tf
    values[np.repeat(base + 2 * counts, held) + _within(held)] = _deltas(place, d)
    data, first = _to_bytes(values)
    points = letters[code[g][:, None] // len(letters) ** np.arange(Q - 1, -1, -1) % len(letters)]
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    text = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    ends = np.append(0, np.cumsum(size.sum(axis=1))).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.Array.from_buffers(pa.string(), len(g), [None, pa.py_buffer(ends), pa.py_buffer(text)]), pa.array(np.full(len(g), number), pa.int64()), pa.array(counts, pa.int32()), pa.array(held, pa.int64()),
            pa.array(np.maximum.reduceat(tf, of_gram), pa.int32()), pa.array(np.minimum.reduceat(lens[doc[d]], of_gram), pa.int32()),
            pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(np.append(first[base], len(data)).astype(np.int32)), pa.py_buffer(data)]), pa.nulls(len(g), kinds[-2]), pa.nulls(len(g), kinds[-1]),
        ],
        names=names,
    )


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> Index:
    """Write the index of docs below path: one pass over the texts, a segment for each of its tasks (``files`` at most)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).filter("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = sorted(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True), key=lambda r: (len(r[0]), r[1]))
            held, chars = [], 0
            for t, i in [*rows, (None, None)]:
                if held and (t is None or len(held) == BLOCK_DOCS or chars + len(t) > BLOCK_CHARS):
                    yield from _block([x for x, _ in held], [x for _, x in held], number)
                    number, held, chars = number + 1, [], 0
                if t is not None:
                    held.append((t, i))
                    chars += len(t)

    made = (plain.coalesce(files) if files else plain).mapInArrow(run, _COLUMNS)
    # small row groups: a reader that wants few grams passes over the others
    made.sortWithinPartitions("gram", "block").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    n, chars = Index(path, 0, 0.0).blocks(docs.sparkSession).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    index = Index(path, n, chars / n if n else 0.0)
    docs.sparkSession.createDataFrame([(n, index.mean)], "documents long, mean double").coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
    return index


def load(spark, path: str) -> Index:
    """An index that was written before."""
    n, mean = spark.read.schema("documents long, mean double").json(f"{path}/statistics").first()
    return Index(path, n, mean)


def _all_grams(clause: str) -> list[str]:
    return qgram.grams_of(clause)


def _cover(clause: str) -> list[tuple[str, int]]:
    """(gram, offset) of as few grams as cover a clause; of a shorter one, itself."""
    if len(clause) < Q:
        return [(clause, 0)]
    return [(clause[i : i + Q], i) for i in sorted({*range(0, len(clause) - Q + 1, Q), len(clause) - Q})]


def _is(gram: Column, wanted: str) -> Column:
    return gram == wanted if len(wanted) == Q else gram.startswith(wanted)


def _of(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The rows of these grams: a filter on the sorted column, which the reader is given."""
    full, short = [g for g in grams if len(g) == Q], [g for g in grams if len(g) < Q]
    tests = ([F.col("gram").isin(full)] if full else []) + [F.col("gram").startswith(g) for g in short]
    return rows.filter(reduce(lambda a, b: a | b, tests))


def _entries(rows: DataFrame) -> DataFrame:
    """(block, clause, many, doc, at): the documents of rows of a clause, by their numbers in the block, and the places less ``off``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, doc, tf, places = _unpack(b.column(5).to_pylist(), b.column(4).to_numpy().astype(np.int64))
                block, clause, many, off = (b.column(k).to_numpy()[row] for k in range(4))
                columns = [pa.array(block, pa.int64()), pa.array(clause, pa.int32()), pa.array(many, pa.int32()), pa.array(doc, pa.int32()), _lists(places - np.repeat(off, tf), tf, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "clause", "many", "doc", "at"])

    return rows.select("block", "clause", "many", "off", "n", "packed").mapInArrow(run, "block long, clause int, many int, doc int, at array<int>")


class Search:
    """A query against an index; scores are those of ``qgram.search`` (plain)."""

    def __init__(self, spark, index: Index, query: str):
        self.spark, self.index, self.clauses = spark, index, parse_query(query)
        self.rows = index.postings(spark)
        self.grams = sorted({g for c in self.clauses for g in _all_grams(c)})
        if self.clauses:
            meta = _of(self.rows, self.grams)
            held = meta.agg(*[F.coalesce(F.sum(F.when(_is(F.col("gram"), g), F.col("n"))), F.lit(0)) for g in self.grams]).first()
            self.df = dict(zip(self.grams, held, strict=True))
            for g in self.grams:
                if len(g) < Q:  # a document may hold several of the grams that begin so
                    some = meta.filter(_is(F.col("gram"), g)).withColumns({c: F.lit(0) for c in ("clause", "many", "off")})
                    self.df[g] = _entries(some).select("block", "doc").distinct().count()
        self.weights = [max((qgram.idf(index.documents, self.df[g]) for g in _all_grams(c)), default=0.0) for c in self.clauses]

    def _saturated(self, tf: Column, length: Column) -> Column:
        x = tf / (1 - qgram.B + qgram.B * length / (self.index.mean or 1.0))
        return (qgram.K1 + 1) * x / (qgram.K1 + x)

    def blocks(self) -> DataFrame:
        """(block, n, bound): blocks that hold all grams of a clause, the candidates there at most, and what no score in them exceeds."""
        meta = _of(self.rows, self.grams).select("gram", "block", "n", "max_tf", "min_len")
        by = []
        for i, c in enumerate(self.clauses):
            grams = _all_grams(c)
            one = _of(meta, grams)
            if len(c) < Q:
                one = one.groupBy("block").agg(F.sum("n").alias("n"), F.sum("max_tf").alias("tf"), F.min("min_len").alias("len"))
            else:
                one = one.groupBy("block").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("n"), F.min("max_tf").alias("tf"), F.max("min_len").alias("len"))
                one = one.filter(F.col("g") == len(grams)).drop("g")
            by.append(one.select("block", "n", "tf", (self.weights[i] * self._saturated(F.col("tf"), F.col("len"))).alias("s")))
        both = reduce(DataFrame.unionByName, by).groupBy("block").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list("tf"), False).alias("tfs"))
        common = F.least(F.lit(qgram.SEGMENTS), F.coalesce(F.get("tfs", F.lit(1)), F.lit(0)))  # bits that two clauses share at most
        near = F.when(F.col("m") > 1, 1 + qgram.ALPHA * common / 2).otherwise(1.0)
        bound = F.col("s") * F.pow(qgram.EPSILON + F.col("m") / float(len(self.clauses)), F.lit(qgram.LAMBDA)) * near
        return both.select("block", "n", bound.alias("bound"))

    def hits(self, blocks: DataFrame | None = None) -> DataFrame:
        """(id, score, matched) of the documents of these blocks (all blocks if none are given) that hold a clause."""
        cover = [(i, g, off, len(_cover(c))) for i, c in enumerate(self.clauses) for g, off in _cover(c)]
        rows = _of(self.rows, sorted({g for _, g, _, _ in cover}))
        if blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")
        wanted = F.array(*[F.when(_is(F.col("gram"), g), F.struct(F.lit(i).alias("clause"), F.lit(off).alias("off"), F.lit(many if len(g) == Q else 0).alias("many"))) for i, g, off, many in cover])
        rows = rows.withColumn("c", F.explode(F.filter(wanted, lambda x: x.isNotNull())))
        lists = _entries(rows.select("block", "c.*", "n", "packed")).groupBy("block", "doc", "clause", "many").agg(F.collect_list("at").alias("lists"))
        # all grams of the cover, at the right distances; a short clause stands wherever one of its grams begins
        lists = lists.filter((F.col("many") == 0) | (F.size("lists") == F.col("many")))
        at = F.when(F.col("many") == 0, F.flatten("lists")).otherwise(F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b)))
        found = lists.select("block", "doc", "clause", at.alias("at")).filter(F.size("at") > 0)
        known = self.index.blocks(self.spark).select("block", F.posexplode(F.arrays_zip("ids", "lens")).alias("doc", "d")).select("block", "doc", F.col("d.ids").alias("id"), F.col("d.lens").alias("size"))
        found = found.join(known, ["block", "doc"])
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.lit(qgram.SEGMENTS - 1), F.floor(p * qgram.SEGMENTS / F.greatest("size", F.lit(1))).cast("int")))
        mask = F.aggregate("at", F.lit(0).cast("bigint"), lambda a, p: a.bitwiseOR(bit(p)))
        weight = F.element_at(F.array(*map(F.lit, self.weights)), F.col("clause") + 1)
        phrase = F.col("clause").isin([i for i, c in enumerate(self.clauses) if " " in c])
        one = found.select("block", "doc", "id", "size", (weight * self._saturated(F.size("at"), F.col("size"))).alias("s"), mask.alias("mask"), phrase.cast("int").alias("phrase"))
        doc = one.groupBy("block", "doc", "id", "size").agg(F.sum("s").alias("base"), F.count(F.lit(1)).cast("int").alias("matched"), F.bit_and("mask").alias("common"), F.sum("phrase").alias("phrases"))
        doc = doc.filter(F.col("phrases") == sum(" " in c for c in self.clauses))
        decay = F.exp(-qgram.DECAY * F.col("size") / (self.index.mean or 1.0))
        near = F.when(F.col("matched") > 1, 1 + qgram.ALPHA * F.bit_count("common") / F.least(F.col("matched"), F.lit(qgram.SEGMENTS)) * decay).otherwise(1.0)
        score = F.col("base") * F.pow(qgram.EPSILON + F.col("matched") / float(len(self.clauses)), F.lit(qgram.LAMBDA)) * near
        return doc.select("id", score.alias("score"), "matched")

    def best(self, k: int, digits: int = 6) -> tuple[DataFrame, Reading]:
        """The k best hits (scores rounded, then ids), and what was read for them."""
        if not self.clauses:
            return self.spark.createDataFrame([], "id long, score double, matched int"), Reading(0, 0, 0)
        blocks = self.blocks().cache()
        try:
            total = blocks.count()
            top = blocks.orderBy(F.desc("bound"), "block").limit(max(1, k)).collect()  # k blocks hold k candidates
            held, take = 0, []
            for b in top:
                if held >= 2 * k and take:
                    break
                take.append(b.block)
                held += b.n
            first = self.hits(blocks.filter(F.col("block").isin(take))).withColumn("score", F.round("score", digits))
            order = [F.desc("score"), "id"]
            one = [(r.id, r.score, r.matched) for r in first.orderBy(*order).limit(k).collect()]
            least = one[-1][1] if len(one) == k else -math.inf
            # a bound is compared with the slack of rounding, as scores are
            rest = blocks.filter(~F.col("block").isin(take) & (F.col("bound") >= least - 10.0**-digits))
            more = rest.count()
            two = []
            if more:
                second = self.hits(rest).withColumn("score", F.round("score", digits))
                two = [(r.id, r.score, r.matched) for r in second.orderBy(*order).limit(k).collect()]
        finally:
            blocks.unpersist()
        kept = sorted(one + two, key=lambda r: (-r[1], r[0]))[:k]
        return self.spark.createDataFrame(kept, "id long, score double, matched int"), Reading(total, len(take), more)


def search(spark, index: Index, query: str) -> DataFrame:
    """(id, score, matched) of all hits."""
    if not parse_query(query):
        return spark.createDataFrame([], "id long, score double, matched int")
    return Search(spark, index, query).hits()
