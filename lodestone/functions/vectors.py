"""Vector functions and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, PIECE = 4096, 16_384
AT_ONCE = 128  # queries of a block whose scores are held at a time


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    m = magnitude(a) * magnitude(b)
    return F.when(m > 0, dot(a, b) / m).otherwise(0.0)


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def poincare_distance(a: str, b: str) -> Column:
    """Distance in the unit Poincare ball."""
    return F.acosh(1 + 2 * squared_distance(a, b) / ((1 - dot(a, a)) * (1 - dot(b, b))))


def scalar_quantise(a: str) -> Column:
    """struct(min, scale, codes): codes round((v - min) / scale) of 0..255, scale (max - min) / 255 or 1."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    scale = F.when(hi > lo, (hi - lo) / 255).otherwise(1.0)
    return F.struct(lo.alias("min"), scale.alias("scale"), F.transform(a, lambda v: F.floor((v.cast("double") - lo) / scale + 0.5).cast("int")).alias("codes"))


def sign_bits(a: str) -> Column:
    """Longs of 64 bits each: bit i of the k-th is set if component 64 k + i is not negative."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def word(k: Column) -> Column:
        bits = F.transform(F.slice(a, k * 64 + 1, F.lit(64)), lambda v, i: F.when(v >= 0, F.call_function("shiftleft", one, i)).otherwise(none))
        return F.aggregate(bits, none, lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def hamming(a: str, b: str) -> Column:
    """The number of different bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _matrix(column) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k best of each row of scores, of equal scores (9 decimals) those of the least ids; -inf takes no part."""
    n = min(k, score.shape[1])
    # the k-th highest of the maxima of strips is no higher than the k-th score, and far cheaper to find
    strips = score.shape[1] // 16
    held = score[:, : strips * 16].reshape(len(score), strips, 16).max(axis=2) if strips >= 4 * n else score
    least = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]
    row, at = np.nonzero((score >= least[:, None] - 2e-9) & (score > -np.inf))
    order = np.lexsort((ids[at], -np.round(score[row, at], 9), row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[kept], at[kept]


def _scores(q: np.ndarray, of: np.ndarray, m: np.ndarray, ids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Cosines of some queries after others with all rows; -inf for a query itself and for what is no number."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], of, side) for side in ("left", "right"))
    lost, void = np.isnan(m).any(axis=1), np.isnan(q).any(axis=1)
    for lo in range(0, len(q), AT_ONCE):
        now = slice(lo, min(lo + AT_ONCE, len(q)))
        s = q[now] @ m.T
        for i in np.flatnonzero(high[now] > low[now]):
            s[i, order[low[lo + i] : high[lo + i]]] = -np.inf
        if lost.any():
            s[:, lost] = -np.inf
        s[void[now]] = -np.inf
        yield now, s


def meet(rows: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query, id, cosine): in every group of keys, for each query the k nearest rows but itself.
    rows: keys, id, v; asked: keys, query, qv.  Both sides of a group are held in one task, so
    the caller deals large ones over pieces and blocks; nothing passes through the driver."""
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, of, out = left["id"].to_numpy(), right["query"].to_numpy(), []
        for now, s in _scores(_unit(right["qv"]), of, _unit(left["v"]), ids):
            n, at = _first(s, ids, k)
            out.append(pa.table([of[now][n], ids[at], s[n, at]], schema=schema))
        return pa.concat_tables(out)

    return rows.select(*keys, "id", "v").groupBy(*keys).cogroup(asked.select(*keys, "query", "qv").groupBy(*keys)).applyInArrow(top, "query long, id long, cosine double")


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", within: str | None = None) -> DataFrame:
    """(query, id, cosine, rank) by exact search; with ``within``, among rows that share the query's value of that column.
    A grid for each value: pieces of at most about PIECE rows and blocks of at most about QUERY_BLOCK queries; every
    task holds one block against one piece, AT_ONCE queries at a time, and keeps k per query.  Null vectors and ids take no part."""
    has = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
    scope = F.coalesce(F.col(within).cast("string"), F.lit("\\N")) if within else F.lit("")
    rows = vectors.filter(has).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), scope.alias("scope"))
    asked = queries.filter(has).select(F.col(id_col).cast("long").alias("query"), F.col(vec_col).alias("qv"), scope.alias("scope"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sizes = rows.select("scope", one.alias("n"), none.alias("q")).unionByName(asked.select("scope", none.alias("n"), one.alias("q"))).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    # only values of many rows or queries: few, whatever the number of values
    large = F.broadcast(sizes.filter((F.col("n") > PIECE) | (F.col("q") > QUERY_BLOCK)).select("scope", F.ceil(F.col("n") / PIECE).alias("pieces"), F.ceil(F.col("q") / QUERY_BLOCK).alias("blocks")))
    many = lambda c: F.greatest(F.coalesce(c, one), one)
    all_of = lambda c: F.explode(F.sequence(none, many(F.col(c)) - 1))
    rows = rows.join(large, "scope", "left").withColumn("piece", F.pmod(F.xxhash64("id"), many(F.col("pieces")))).withColumn("block", all_of("blocks"))
    asked = asked.join(large, "scope", "left").withColumn("block", F.pmod(F.xxhash64("query"), many(F.col("blocks")))).withColumn("piece", all_of("pieces"))
    return ranked(meet(rows, asked, ["scope", "piece", "block"], k), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with ``rank``: of each query's rows the k with the highest cosine (9 decimals), then the least ids."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, k: int, balance: float) -> DataFrame:
    """(query, id, place) by maximal marginal relevance: greedily the candidate with the highest
    balance * relevance - (1 - balance) * similarity to what is chosen (at least 0); of equals the first.
    candidates: query, id, cosine, v (vector), order; a query's candidates are a bounded top list."""

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("order").reset_index(drop=True)
        m, rel = _matrix(f["v"]), f["cosine"].to_numpy()
        close, left, chosen = np.zeros(len(f)), np.ones(len(f), bool), []
        for _ in range(min(k, len(f))):
            score = np.where(left, np.round(balance * rel - (1 - balance) * close, 9), -np.inf)
            at = int(score.argmax())
            chosen.append(at)
            left[at] = False
            close = np.maximum(close, m @ m[at])
        return pd.DataFrame({"query": f["query"].iloc[chosen], "id": f["id"].iloc[chosen], "place": range(1, len(chosen) + 1)})

    return candidates.groupBy("query").applyInPandas(greedy, "query long, id long, place long")
