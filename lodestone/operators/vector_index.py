"""A stored index for approximate nearest neighbours: cells around centroids, residual codes, exact rerank.

Centroids are fitted on at most ``SAMPLE`` rows (those of the least hashes of their ids) by
seeded spherical k-means.  Every row is written to the folder of its nearest centroid, with
its vector and one byte per component of its difference from the centroid.  A search gives each
query its ``probes`` nearest cells, meets codes there, and reranks the best by the vectors
themselves.  Queries are a table that is joined to cells; large cells are dealt over pieces.
``tune`` takes the number of probes from the recall of a bounded sample of queries.

``upsert`` and ``delete`` rewrite the cells that they touch and no others; a reader of these
cells must not run at the same time.

Defined results: rows with a null id or vector are not indexed; ids are unique, of repeated ones
one is kept; a vector of zeros has cosine 0 with all; an empty table makes an index without cells
that finds nothing; all vectors have one length, else ``ValueError`` (``by_dimension`` splits
a table by length into one index each).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.functions import vectors

SAMPLE, ROUNDS, MOST_CELLS, SEED = 20_000, 10, 4096, 42
TUNED = 200  # queries that choose the number of probes
PIECE, ASKED = 8192, 65_536  # rows of a cell and queries, about, that meet in one task
SHORTLIST = 4  # times k: rows of the codes that are reranked
_ROWS = "id long, v array<float>, scale float, code binary, cell int"


def kmeans(m: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit rows: seeded starts far apart, then rounds of means; an empty cell keeps its centroid."""
    r = np.random.default_rng(seed)
    chosen = [int(r.integers(len(m)))]
    near = m @ m[chosen[0]]
    while len(chosen) < k:
        gap = np.maximum(0.0, 1 - near)
        chosen.append(int(r.choice(len(m), p=gap / gap.sum())) if gap.sum() > 0 else int(r.integers(len(m))))
        near = np.maximum(near, m @ m[chosen[-1]])
    c = m[chosen].copy()
    for _ in range(rounds):
        of = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


@dataclass
class VectorIndex:
    path: str
    centres: np.ndarray
    probes: int = 1
    _sizes: dict[int, int] | None = field(default=None, repr=False)

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(_ROWS).parquet(f"{self.path}/rows") if len(self.centres) else spark.createDataFrame([], _ROWS)

    def sizes(self, spark) -> dict[int, int]:
        """The rows of each cell: at most ``MOST_CELLS`` numbers."""
        if self._sizes is None:
            self._sizes = {r.cell: r["count"] for r in self.rows(spark).groupBy("cell").count().collect()}
        return self._sizes


def _pick(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")


def _coded(vecs: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows of the index of (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = vectors._unit(pa.chunked_array([b.column(1)]))
            cell = (m @ centres.T).argmax(axis=1)
            rest = m - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "v", "scale", "code", "cell"],
            )

    return vecs.mapInArrow(run, _ROWS)


def build(vecs: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Write an index of all rows of vecs below path.  cells: the square root of the rows if not given, at most MOST_CELLS."""
    spark = vecs.sparkSession
    plain = _pick(vecs, id_col, vec_col)
    n, low, high = plain.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and low != high:
        raise ValueError("vectors of several lengths: build one index for each")
    if not n:
        return VectorIndex(path, np.zeros((0, 0)))
    held = plain.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # a bounded sample
    m = np.stack(held["v"]).astype(np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    centres = kmeans(m, min(cells or max(1, math.isqrt(n)), MOST_CELLS, len(m)))
    coded = _coded(plain.dropDuplicates(["id"]), centres)
    coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (len(centres) * 1_000_000))))).sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(path, centres)
    _save(spark, index)
    return index


def _save(spark, index: VectorIndex) -> None:
    rows = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, v array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centres")


def load(spark, path: str) -> VectorIndex:
    """An index that was written before."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return VectorIndex(path, np.array([r.v for r in rows]), rows[0].probes)


def by_dimension(vecs: DataFrame, path: str, vec_col: str = "embedding", **args) -> dict[int, VectorIndex]:
    """One index for each length of vectors; a query goes to that of its own length."""
    lengths = [r[0] for r in vecs.select(F.size(vec_col).alias("n")).filter("n >= 0").distinct().limit(1000).collect()]
    return {n: build(vecs.filter(F.size(vec_col) == n), f"{path}/{n}", vec_col=vec_col, **args) for n in sorted(lengths)}


def _asked(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(cell, query, qv): each query with its nearest cells."""
    centres = index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = vectors._unit(pa.chunked_array([b.column(1)])) @ centres.T
                cells = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(b.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["cell", "query", "qv"])

    return queries.mapInArrow(run, "cell int, query long, qv array<float>")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, cosine, rank): of each query the k nearest rows that its cells hold, itself not among them.
    A search of all cells is exact, on the grid of ``vectors.nearest``."""
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "query long, id long, cosine double, rank int")
    asked = _pick(queries, id_col, vec_col)
    if (probes or index.probes) >= len(index.centres):  # every query meets every row: a shortlist from each cell would only be in the way
        return vectors.nearest(index.rows(spark), asked, k, "id", "v")
    centres, first = index.centres, max(k, SHORTLIST * k)
    sizes = index.sizes(spark)
    pieces = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(max(1, -(-n // PIECE))).cast("long"))]) if sizes else None
    if pieces is None:
        return spark.createDataFrame([], "query long, id long, cosine double, rank int")
    of = F.coalesce(pieces[F.col("cell")], F.lit(1).cast("long"))
    probes = min(probes or index.probes, len(centres))
    blocks = -(-asked.count() * probes // (len(centres) * ASKED))  # more than one if cells have very many queries
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    probed = _asked(index, asked, probes).withColumn("piece", all_of(of)).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))))
    rows = index.rows(spark).select("cell", "id", "scale", "code").withColumn("piece", F.pmod(F.xxhash64("id"), of)).withColumn("block", all_of(F.lit(max(1, blocks)).cast("long")))
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, of_query, cell = left["id"].to_numpy(), right["query"].to_numpy(), left["cell"][0].as_py()
        code = np.frombuffer(b"".join(left["code"].to_pylist()), np.int8).reshape(len(ids), -1)
        m = code * left["scale"].to_numpy()[:, None].astype(np.float64) + centres[cell]
        out = []
        for now, s in vectors._scores(vectors._unit(right["qv"]), of_query, m, ids):
            n, at = vectors._first(s, ids, first)
            out.append(pa.table([of_query[now][n], ids[at], s[n, at]], schema=schema))
        return pa.concat_tables(out)

    keys = ["cell", "piece", "block"]
    met = rows.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInArrow(top, "query long, id long, near double")
    short = vectors.ranked(met.withColumnRenamed("near", "cosine"), first).select("query", "id")
    full = short.join(index.rows(spark).select("id", "v"), "id").join(asked.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")
    return vectors.ranked(full.select("query", "id", vectors.cosine("v", "qv").alias("cosine")), k)


def tune(index: VectorIndex, spark, k: int = 10, recall: float = 0.95) -> VectorIndex:
    """The index with as many probes as find ``recall`` of the k nearest rows of TUNED of its rows, by exact search."""
    if not len(index.centres):
        return index
    rows = index.rows(spark)
    some = rows.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(TUNED).select("id", "v")
    exact = vectors.nearest(rows, some, k, "id", "v").join(rows.select("id", "cell"), "id").select("query", "cell").toPandas()  # k * TUNED rows
    if len(exact):
        held = some.toPandas()
        m = np.stack(held["v"]).astype(np.float64)
        place = np.argsort(np.argsort(-(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)) @ index.centres.T, axis=1, kind="stable"), axis=1)
        at = {q: i for i, q in enumerate(held["id"])}
        need = np.sort(place[exact["query"].map(at).to_numpy(), exact["cell"].to_numpy()])
        index.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)]) + 1
        _save(spark, index)
    return index


def _rewrite(index: VectorIndex, spark, gone: DataFrame, fresh: DataFrame | None) -> None:
    """The cells that hold ids of gone or take rows of fresh, written anew."""
    scratch = Scratch(spark, "vector-index")
    rows = index.rows(spark)
    gone = scratch.table(gone.select("id").distinct(), "gone")
    touched = rows.join(gone, "id", "left_semi").select("cell")
    if fresh is not None:
        fresh = scratch.table(_coded(fresh.dropDuplicates(["id"]), index.centres), "fresh")
        touched = touched.union(fresh.select("cell"))
    cells = [r[0] for r in touched.distinct().collect()]  # at most MOST_CELLS
    kept = rows.filter(F.col("cell").isin(cells)).join(gone, "id", "left_anti").select("id", "v", "scale", "code", "cell")
    new = scratch.table(kept if fresh is None else kept.unionByName(fresh), "cells")
    left = {r[0] for r in new.select("cell").distinct().collect()}
    new.repartition("cell").sortWithinPartitions("cell", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{index.path}/rows")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for c in set(cells) - left:  # a cell without rows has no folder
        p = hadoop(f"{index.path}/rows/cell={c}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    index._sizes = None


def upsert(index: VectorIndex, vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Add rows; a row of the same id is replaced, also if it moves to another cell."""
    plain = _pick(vecs, id_col, vec_col)
    _rewrite(index, vecs.sparkSession, plain, plain)


def delete(index: VectorIndex, ids: DataFrame, id_col: str = "vec_id") -> None:
    _rewrite(index, ids.sparkSession, ids.select(F.col(id_col).cast("long").alias("id")), None)
