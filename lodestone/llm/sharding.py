"""Sharding by extendible hashing.

Every row has a fixed bit path: 60 bits of md5(id, text), then 60 bits of a hash
of its row number.  A shard is a prefix of that path; the directory starts with
the empty prefix and only a bucket over the byte limit is split on its next bit.
The shard of a row is therefore the shortest prefix of its path whose rows fit.
Sums per prefix are aggregated before they are shuffled, so a hot source or a key
with a third of all rows meets no single task.

Defined results: null text counts 0 bytes plus the row overhead; a null id is
hashed as a value of its own; equal rows are split by row number, so any number
of copies fits; one row over the limit has a shard of its own with ``oversize``
true; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._names import fresh

SHARD_BYTES = 16 << 20
ROW_OVERHEAD = 32
_STEP = 3  # bits beyond the number of shards: about 8 cells a shard in each round
_BITS = 120


def _sixty(text_column):
    """60 bits of an md5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text_column), 1, 15), 16, 2), 60, "0")


def row_bytes(text_col: str):
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_bytes, shard, depth, shard_bytes, shard_rows, oversize): one row per input row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))
    rows = scratch.table(
        docs.select(
            F.col(id_col).alias("id"),
            row_bytes(text_col).alias("row_bytes"),
            F.md5(F.concat_ws(":", ident, F.coalesce(F.col(text_col).cast("string"), F.lit("\\N")))).alias("digest"),
        ).withColumn("row_no", F.monotonically_increasing_id()),
        "rows",
    )
    path = F.concat(F.lpad(F.conv(F.substring("digest", 1, 15), 16, 2), 60, "0"), _sixty(F.col("row_no").cast("string")))
    rows = rows.withColumn("path", path)
    total = rows.agg(F.sum("row_bytes")).first()[0] or 0
    low, high = 0, min(_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + _STEP)
    left, directory = rows, None
    while True:
        cells = left.groupBy(F.substring("path", 1, high).alias("cell")).agg(F.sum("row_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        cells = scratch.table(cells, "cells")
        level = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        level = level.withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sums = level.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == _BITS))
        found = (
            # cells and shards grow with the rows: no side of these joins is broadcast
            level.select("cell", "depth", "shard")
            .join(fits.hint("merge"), ["depth", "shard"])
            .groupBy("cell")
            .agg(F.min_by(F.struct("depth", "shard", "shard_bytes", "shard_rows"), "depth").alias("s"))
        )
        found = scratch.table(found.select("cell", "s.*").withColumn("width", F.lit(high)), "directory")
        directory = found if directory is None else directory.unionByName(found)
        deep = scratch.table(cells.join(found.hint("merge"), "cell", "left_anti").select("cell"), "deep")
        scratch.drop(cells)
        if high == _BITS or deep.isEmpty():
            break
        left = left.join(deep.hint("merge"), F.substring(left["path"], 1, high) == deep["cell"], "left_semi")
        low, high = high + 1, min(_BITS, high + 2 * _STEP)
    widths = sorted(r[0] for r in directory.select("width").distinct().collect())  # a handful: one per round
    out = None
    for w in widths:
        d = directory.filter(F.col("width") == w).drop("width")
        part = rows.withColumn("cell", F.substring("path", 1, w)).join(d.hint("merge"), "cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.join(directory, F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "row_bytes", "shard", "depth", "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit).alias("oversize"),
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of docs as one folder per shard below path (``_shard=s<bits>``, with more
    underscores where docs has such a column); returns the assignment.
    The id must be unique here: the assignment is joined back on it."""
    made = shard(docs, limit, id_col, text_col)
    ident, folder = fresh(docs.columns, "_shard_id", "_shard")
    keys = made.select(F.col(id_col).alias(ident), F.concat(F.lit("s"), F.col("shard")).alias(folder))
    docs.join(keys, docs[id_col].eqNullSafe(keys[ident])).drop(ident).repartition(folder).write.partitionBy(folder).parquet(path)
    return made


def op10_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(limit: int = SHARD_BYTES, docs: str = "documents", depth: int = 40) -> str:
    """The same assignment in DuckDB, for ids that are unique: the first ``depth`` bits are enough there."""
    return f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + {ROW_OVERHEAD} AS row_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || coalesce(text, '\\N')), 1, 15))::BIGINT), 60, '0') AS path
  FROM {docs}),
l AS (SELECT doc_id, row_bytes, d.depth, substr(path, 1, d.depth::BIGINT) AS shard FROM r, (SELECT unnest(range(0, {depth + 1}))::INTEGER AS depth) d),
s AS (SELECT depth, shard, sum(row_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL),
f AS (SELECT l.doc_id, l.row_bytes, l.shard, l.depth, s.shard_bytes, s.shard_rows,
    row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k
  FROM l JOIN s USING (depth, shard) WHERE s.shard_bytes <= {limit} OR s.shard_rows = 1)
SELECT doc_id, row_bytes, shard, depth, shard_bytes, shard_rows, shard_bytes > {limit} AS oversize FROM f WHERE k = 1
"""
