"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal if their bytes are after A-Z became a-z.  One pass over the documents gives
every text a 64-bit key (the head of its sha256) and writes the index's entries to the
shared folder: each row points to a representative, the first row of its task that had the
same key and, compared byte by byte, the same text; only representatives carry the text.
So a text held by a third of all rows leaves a task once.

Keys with representatives of several tasks are the index proper.  Its directory is indexed
by the leading bits of the key: all buckets have the depth at which they would be half full,
and as long as a bucket holds more bytes than ``BUCKET_BYTES`` and more than one key, the
directory doubles and the bucket is split on its next bit.  An owner task reads the buckets
of a key range in order of the key and chains the texts of a key: each is compared byte by
byte with the heads of the chain and joins one or becomes another.  A key with more than
``MANY`` representatives is chained in pieces first, then the heads of the pieces.

Defined results: null counts as the empty text; of equal texts the row with the largest id
stays, of rows that share that id one; a null id is smaller than any other; repeated rows
are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._names import fresh
from lodestone.llm.batches import slices

KEY_BITS = 64
BUCKET_BYTES = 64 << 20
SEEN_BYTES = 32 << 20  # texts that a task keeps to compare with; beyond it the oldest half is forgotten
MANY = 4096
BROADCAST_ROWS = 1_000_000  # of two or three longs
_DEPTH = 60
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _entries(docs: DataFrame, key_bits: int) -> DataFrame:
    """(row, id, key, sha, size, rep, text): rep is the row of the representative, text is null unless it is the row itself."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("rep", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = TaskContext.get().partitionId() << 40, 0
        seen: dict[int, list[tuple[int, bytes]]] = {}
        for b in slices(batches, 1):
            texts = pc.ascii_lower(b.column(1).fill_null("")).cast(pa.binary())
            rows, keys, shas, sizes, reps = [], [], [], [], []
            for t in texts.to_pylist():
                sha = hashlib.sha256(t).digest()
                key = int.from_bytes(sha[:8], "big", signed=True) >> (64 - key_bits) << (64 - key_bits)
                chain = seen.setdefault(key, [])
                rep = next((r for r, other in chain if other == t), None)
                if rep is None:
                    rep = row
                    chain.append((row, t))
                    held += len(t)
                rows.append(row)
                keys.append(key)
                shas.append(sha)
                sizes.append(len(t))
                reps.append(rep)
                row += 1
            if held > SEEN_BYTES:  # a text met again gets a representative more
                for k in list(seen)[: (len(seen) + 1) // 2]:
                    held -= sum(len(t) for _, t in seen.pop(k))
            at, to = pa.array(rows, pa.int64()), pa.array(reps, pa.int64())
            own = pc.if_else(pc.equal(at, to), texts, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([at, b.column(0), pa.array(keys, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), to, own], schema=schema)

    return docs.mapInArrow(run, "row long, id long, key long, sha binary, size long, rep long, text binary")


def _prefix(depth: int) -> Column:
    """The bucket of a key at a depth, numbered as in a heap: a one before the leading bits."""
    top = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    return top + F.lit(1 << depth).cast("long")


def directory(keys: DataFrame, scratch: Scratch, limit: int = BUCKET_BYTES) -> DataFrame:
    """(key, reps, bucket) of keys (key, reps, bytes), each in the bucket that the directory leads to."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth = min(_DEPTH, max(0, math.ceil(math.log2(max(1, 2 * total / limit)))))
    left, out = keys, None
    while True:
        at = left.withColumn("bucket", _prefix(depth))
        sums = at.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        full = scratch.table(sums.filter((F.col("b") > limit) & (F.col("n") > 1)).select("bucket"), "full")
        last = depth == _DEPTH or full.isEmpty()
        done = at if last else at.join(full.hint("merge"), "bucket", "left_anti")
        done = done.select("key", "reps", "bucket")
        out = done if out is None else out.unionByName(done)
        if last:
            return scratch.table(out, "directory")
        left = scratch.table(at.join(full.hint("merge"), "bucket", "left_semi").select("key", "reps", "bytes"), "left")
        depth += 1


def _chained(rows: DataFrame) -> DataFrame:
    """(key, rep, head) of rows (bucket, piece, key, rep, text): texts of a key and piece that are equal share a head."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("head", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for b in slices(batches, 3):
            heads = []
            for key, piece, rep, text in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2), b.column(3))), strict=True):
                if now != (key, piece):
                    now, chain = (key, piece), []
                head = next((r for r, other in chain if other == text), None)
                if head is None:
                    head = rep
                    chain.append((rep, text))
                heads.append(head)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(heads, pa.int64())], schema=schema)

    owned = rows.repartition("bucket", "piece").sortWithinPartitions("bucket", "key", "piece", "rep")
    return owned.select("key", "piece", "rep", "text").mapInArrow(run, "key long, rep long, head long")


def _fit(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES, many: int = MANY) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): one row per row of docs."""
    scratch = Scratch(docs.sparkSession, "exact", sweep=True)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = scratch.table(_entries(plain, key_bits), "entries")
    firsts = held.filter(F.col("row") == F.col("rep"))
    shared = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("reps"), F.sum("size").alias("bytes")).filter("reps > 1")
    index = directory(scratch.table(shared, "shared"), scratch, bucket_bytes)
    n_keys, most = index.agg(F.count(F.lit(1)), F.coalesce(F.max("reps"), F.lit(0))).first()

    entries = firsts.select("key", "rep", "text").join(_fit(index, n_keys), "key")
    links = scratch.table(_chained(entries.withColumn("piece", F.pmod(F.xxhash64("rep"), F.ceil(F.col("reps") / many)))), "links")
    if most > many:
        hot = index.filter(F.col("reps") > many)
        heads = links.filter("rep = head").join(_fit(hot.select("key", "bucket"), n_keys), "key").select("rep", "bucket")
        again = firsts.select("key", "rep", "text").join(heads.hint("merge"), "rep").withColumn("piece", F.lit(0).cast("long"))
        joined = scratch.table(_chained(again), "heads").select(F.col("rep").alias("head"), F.col("head").alias("top"))
        links = scratch.table(links.join(joined.hint("merge"), "head", "left").select("key", "rep", F.coalesce("top", "head").alias("head")), "links")

    # representatives of more than one row, and the class of each
    busy = held.filter(F.col("row") != F.col("rep")).select("rep", F.lit(None).cast("long").alias("head")).union(links.select("rep", "head"))
    busy = scratch.table(busy.groupBy("rep").agg(F.coalesce(F.max("head"), F.col("rep")).alias("head")), "busy")
    n_busy = busy.count()
    members = held.select("row", "id", "rep").join(_fit(busy, n_busy), "rep")
    totals = members.groupBy("head").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    busy = scratch.table(busy.join(totals.hint("merge"), "head").select("rep", "group_size", "keep"), "totals")
    out = held.select("row", "id", "rep", "sha").join(_fit(busy, n_busy), "rep", "left")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept, whatever their names."""
    ident, sha, gone_id, gone_sha = fresh(docs.columns, "exact_id", "exact_sha", "gone_id", "gone_sha")
    found = Scratch(docs.sparkSession, "exact-clean").table(groups(docs, id_col, text_col), "groups")
    by = found.groupBy(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_sha)).agg(F.max("kept").alias("k"), F.count(F.lit(1)).alias("n"))
    rows = docs.select("*", F.col(id_col).cast("long").alias(ident), F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _UPPER.lower()), 256).alias(sha))
    rows = rows.join(by.filter("NOT k").select(gone_id, gone_sha), F.col(ident).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    if not by.filter("k AND n > 1").isEmpty():
        rows = rows.dropDuplicates([ident, sha])
    return rows.drop(ident, sha)


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    return f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""
