"""Points on the Poincare ball and the unit sphere, and two-stage search on sign bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors


def scaled(a: str, length: Column) -> Column:
    """The vector a shrunk or stretched to a length; a zero vector stays."""
    m = vectors.magnitude(a)
    factor = F.when(m > 0, length / m).otherwise(0.0)
    return F.transform(F.col(a), lambda x: x.cast("double") * factor)


def mobius_add(a: str, b: str) -> Column:
    """Sum of two points of the unit ball (curvature -1)."""
    ab, aa, bb = vectors.dot(a, b), vectors.dot(a, a), vectors.dot(b, b)
    below = 1 + 2 * ab + aa * bb
    return F.zip_with(a, b, lambda x, y: ((1 + 2 * ab + bb) * x + (1 - aa) * y) / below)


def geodesic(a: str, b: str) -> Column:
    """Angle between two vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.cosine(a, b))))


def two_stage(rows: DataFrame, queries: DataFrame, k: int, factor: float = 4.0, share: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, hamming, cosine, rank): the ceil(k * factor) nearest by sign bits, or the nearest ``share`` of all
    rows if that is more (recall falls if the shortlist does not grow with the rows), ordered by exact cosine.
    The queries are a stated list; each is held against all rows, in pieces by ranges of ids.  A first pass counts each
    query's rows of a piece by their distance; from the counts follow the last distance that is shortlisted and how many
    rows of it (those of the least ids) each piece gives.  The second pass ranks what is shortlisted in its piece and
    keeps k, so no shortlist is ever written.  Null vectors and ids take no part; all vectors have one length."""
    has = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
    pick = lambda t, i, v, b: t.filter(has).select(F.col(id_col).cast("long").alias(i), F.col(vec_col).alias(v), vectors.sign_bits(vec_col).alias(b))
    n, held = rows.count(), rows.filter(has).count()
    first = max(k, int(-(-k * factor // 1)), int(-(-share * n // 1)) if share else 0)
    pieces, blocks = max(1, -(-held // vectors.PIECE)), max(1, -(-queries.count() // vectors.QUERY_BLOCK))
    cuts = [i / pieces for i in range(1, pieces)]
    edges = (rows.filter(has).agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, 100 * pieces)).first()[0] or []) if cuts else []
    piece = F.aggregate(F.array(*[F.lit(x).cast("long") for x in sorted(set(edges))]).cast("array<bigint>"), F.lit(0), lambda s, x: s + (F.col("id") >= x).cast("int"))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    r = pick(rows, "id", "v", "b").withColumn("piece", piece).withColumn("block", all_of(blocks))
    q = pick(queries, "query", "qv", "qb").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    asked, keys = q.withColumn("piece", all_of(len(set(edges)) + 1)), ["piece", "block"]
    counted = r.select(*keys, "id", "b").groupBy(*keys).cogroup(asked.select(*keys, "query", "qb").groupBy(*keys)).applyInArrow(_counts, "query long, piece int, counts array<int>")
    cut = counted.groupBy("query").applyInArrow(lambda t: _cut(t, first), "query long, piece int, last int, ties int")
    met = asked.join(cut, ["query", "piece"])
    found = r.groupBy(*keys).cogroup(met.select(*keys, "query", "qv", "qb", "last", "ties").groupBy(*keys)).applyInArrow(lambda a, b: _shortlisted(a, b, k), "query long, id long, hamming int, cosine double")
    return vectors.ranked(found, k)


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of 1 and -1 for the bits that are set and are not."""
    words = np.array(column.to_pylist(), np.int64)
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1).astype(np.float32) * 2 - 1


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.shape[1] - left @ right.T) / 2).astype(np.int16)


def _counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many rows of a piece are at each distance of a query, itself left out."""
    schema = pa.schema([("query", pa.int64()), ("piece", pa.int32()), ("counts", pa.list_(pa.int32()))])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    rows, asked, ids, of = _signs(left["b"]), _signs(right["qb"]), left["id"].to_numpy(), right["query"].to_numpy()
    width, out = rows.shape[1] + 1, []
    for lo in range(0, len(of), vectors.AT_ONCE):
        h, some = _distances(asked[lo : lo + vectors.AT_ONCE], rows), of[lo : lo + vectors.AT_ONCE]
        c = np.bincount((h + np.arange(len(some))[:, None] * width).ravel(), minlength=len(some) * width).reshape(len(some), width)
        for i in np.flatnonzero(np.isin(some, ids)):
            c[i] -= np.bincount(h[i, ids == some[i]], minlength=width)
        out += c.tolist()
    return pa.table([of, np.full(len(of), left["piece"][0].as_py(), np.int32), out], schema=schema)


def _cut(t: pa.Table, first: int) -> pa.Table:
    """The last distance that the ``first`` nearest of a query reach, and the rows of it that are among them in each piece."""
    t = t.sort_by("piece")
    counts = np.array(t["counts"].to_pylist(), np.int64)
    upto = counts.sum(axis=0).cumsum()
    last = min(int(np.searchsorted(upto, first)), len(upto) - 1)
    here = counts[:, last]
    ties = np.clip(first - (upto[last - 1] if last else 0) - (here.cumsum() - here), 0, here)
    return pa.table({"query": t["query"], "piece": t["piece"], "last": pa.array(np.full(len(t), last, np.int32)), "ties": pa.array(ties.astype(np.int32))})


def _shortlisted(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k rows of a piece with the highest cosine among those that are shortlisted."""
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("hamming", pa.int32()), ("cosine", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    left = left.sort_by("id")  # the rows of the last distance are taken by their ids
    rows, asked, ids, of = _signs(left["b"]), _signs(right["qb"]), left["id"].to_numpy(), right["query"].to_numpy()
    last, ties, out = right["last"].to_numpy(), right["ties"].to_numpy(), []
    for now, s in vectors._scores(vectors._unit(right["qv"]), of, vectors._unit(left["v"]), ids):
        h = _distances(asked[now], rows)
        for i, (edge, n) in enumerate(zip(last[now].tolist(), ties[now].tolist(), strict=True)):
            s[i, h[i] > edge] = -np.inf
            at = np.flatnonzero((h[i] == edge) & (ids != of[now][i]))
            s[i, at[n:]] = -np.inf
        n, at = vectors._first(s, ids, k)
        out.append(pa.table([of[now][n], ids[at], h[n, at].astype(np.int32), s[n, at]], schema=schema))
    return pa.concat_tables(out)


def log_origin(a: str) -> Column:
    """A point of the unit ball as a tangent vector at the origin: artanh of its length along it, twice."""
    m = vectors.magnitude(a)
    factor = F.when(m > 0, 2 * F.atanh(F.least(m, F.lit(1 - 1e-9))) / m).otherwise(0.0)
    return F.transform(F.col(a), lambda x: x.cast("double") * factor)


def exp_origin(a: str) -> Column:
    """The point of the unit ball that a tangent vector at the origin leads to."""
    m = vectors.magnitude(a)
    factor = F.when(m > 0, F.tanh(m / 2) / m).otherwise(0.0)
    return F.transform(F.col(a), lambda x: x.cast("double") * factor)
