"""Removal of repeated passages with fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document.  Every document is cut
into non-overlapping anchor blocks of ``BLOCK`` = WINDOW / 2 words, which form
the index, and is probed with the block at every word position: a window that
also starts in another document covers at least one whole anchor block of that
document, so its probe hits.  Hits are then extended: the windows around them are
compared between documents by a 128-bit hash of all their words, which gives the
maximal exact repeats, and the words that they cover are removed from each
document but the one with the smallest id.

Data movement: texts are dealt once by id and read three times.  Probes travel as
packed arrays, 4 bytes a position, in groups whose number follows the input.
A passage found in many documents of one slice is sent once for all of them, so a
group never gathers a hot passage's documents.

Defined results: null text has no words; documents under WINDOW words lose
nothing; repeats inside one document and between rows of one id do not count;
rows with a null id are kept whole and are no reference; repeated rows give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._text import MULT_A, MULT_B, U, Words, mix, rolling
from lodestone.llm.batches import slices

WINDOW = 50
GROUP_BYTES = 8 << 20  # input bytes for each group of probes
_LOCAL = 8  # a block in more documents of a slice than this is sent once


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


_NULL = np.int64(-(1 << 63))


def _blocks(words: Words, k: int, mult) -> np.ndarray:
    return rolling(words.hashes(mult), k, mult)


def _inside(words: Words, k: int, n: int) -> np.ndarray:
    """Which of the first n word positions start k words of one row."""
    return words.doc[:n] == words.doc[k - 1 : k - 1 + n]


def _pack(p: np.ndarray, ids: np.ndarray, h: np.ndarray, extra: np.ndarray) -> Iterator[tuple]:
    """Rows (group, kind, ids, hashes, extra) with arrays as bytes; p is each element's group."""
    order = np.argsort(p, kind="stable")
    p, ids, h, extra = p[order], ids[order], h[order], extra[order]
    cut = np.flatnonzero(np.diff(p)) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut, [len(p)]))
    for a, b in zip(lo, hi, strict=True):
        yield int(p[a]), ids[a:b].tobytes(), h[a:b].tobytes(), extra[a:b].tobytes()


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PACKED = pa.schema([("p", pa.int32()), ("ids", pa.binary()), ("hs", pa.binary()), ("extra", pa.binary())])
_PACKED_DDL = "p int, ids binary, hs binary, extra binary"
_HIT_DDL = "id long, hits binary"


def _group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h >> U(32)) % U(groups)).astype(np.int32)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by keys (last is primary); (order, number of the run of equal keys but the first key)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys[1:]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def probes(batches: Iterator[pa.RecordBatch], block: int, window: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Every rolling block of every document, packed by group. extra: 1 index anchor, 2 known
    to be repeated inside the slice; such elements are dealt by row, not by hash."""
    for number, b in enumerate(slices(batches, 1)):
        w = Words(b.column(1))
        ids = _ids(b.column(0))
        h = _blocks(w, block, MULT_A)
        if not len(h):
            continue
        at = np.flatnonzero(_inside(w, block, len(h)) & (w.count[w.doc[: len(h)]] >= window) & (ids[w.doc[: len(h)]] != _NULL))
        if not len(at):
            continue
        h, doc = h[at], w.doc[at]
        anchor = ((at - w.first[doc]) % block == 0).astype(np.uint8)
        who = ids[doc]
        # one element for each document and hash; hashes in many documents of this slice are sent once
        order, run = _runs(who, h)
        sorted_h, sorted_who = h[order], who[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (run[1:] != run[:-1]) | (sorted_who[1:] != sorted_who[:-1])
        start = np.flatnonzero(first)
        sorted_anchor = np.maximum.reduceat(anchor[order], start)
        sorted_h, sorted_who, run = sorted_h[start], sorted_who[start], run[start]
        count = np.bincount(run)
        hot = count[run] > _LOCAL
        if hot.any():
            lead = np.ones(len(run), dtype=bool)
            lead[1:] = run[1:] != run[:-1]
            follower = hot & ~lead
            extra = sorted_anchor | (hot.astype(np.uint8) << 1)
            stay = ~follower
            # the leader stands for all: it is an anchor, as one of many documents may well be
            extra[lead & hot] |= 1
            p_local = np.full(int(follower.sum()), number % groups, dtype=np.int32)
            local = list(_pack(p_local, sorted_who[follower], sorted_h[follower], np.full(len(p_local), 4, np.uint8)))
            sorted_h, sorted_who, extra = sorted_h[stay], sorted_who[stay], extra[stay]
        else:
            local, extra = [], sorted_anchor
        # back to document order: equal ids in a run compress to almost nothing
        back = np.argsort(sorted_who, kind="stable")
        sorted_h, sorted_who, extra = sorted_h[back], sorted_who[back], extra[back]
        p = _group_of(sorted_h, groups)
        low = (sorted_h & U(0xFFFFFFFF)).astype(np.uint32)
        rows = [(g, i, hs, e) for g, i, hs, e in _pack(p, sorted_who, low, extra)]
        # followers keep the whole hash: their group says nothing about it
        rows += [(-1 - g, i, hs, e) for g, i, hs, e in local]
        yield _emit(rows, _PACKED)


def _hits(p: int, parts: list[tuple[bytes, bytes, bytes]], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, (group, low hash)) of the blocks that are an anchor and stand in two documents at least."""
    if p < 0:
        ids = np.concatenate([np.frombuffer(x[0], np.int64) for x in parts])
        h = np.concatenate([np.frombuffer(x[1], np.uint64) for x in parts])
        code = (_group_of(h, groups).astype(U) << U(32)) | (h & U(0xFFFFFFFF))
    else:
        ids = np.concatenate([np.frombuffer(x[0], np.int64) for x in parts])
        low = np.concatenate([np.frombuffer(x[1], np.uint32) for x in parts])
        extra = np.concatenate([np.frombuffer(x[2], np.uint8) for x in parts])
        order = np.argsort(low, kind="stable")
        s, i, e = low[order], ids[order], extra[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(new)
        many = (np.minimum.reduceat(i, start) != np.maximum.reduceat(i, start)) | (np.maximum.reduceat(e & 2, start) > 0)
        hit = many & (np.maximum.reduceat(e & 1, start) > 0)
        size = np.diff(np.append(start, len(s)))
        keep = np.repeat(hit, size)
        ids, code = i[keep], (U(p) << U(32)) | s[keep].astype(U)
    return ids, code


def _by_id(ids: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    ids, code = ids[order], code[order]
    cut = np.flatnonzero(np.diff(ids)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)])), strict=True):
        yield int(ids[a]), code[a:b].tobytes()


def _codes(column: pa.Array, i: int) -> np.ndarray:
    v = column[i].as_py()
    return np.frombuffer(v, np.uint64) if v else np.zeros(0, U)


def _candidates(w: Words, at: np.ndarray, block: int, window: int) -> np.ndarray:
    """First words of the windows of one row that hold a hit block; at: hit word positions."""
    reach = window - block
    marks = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(marks, np.maximum(at - reach, w.first[w.doc[at]]), 1)
    np.add.at(marks, at + 1, -1)
    s = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    s = s[s + window <= len(w)]
    return s[w.doc[s] == w.doc[s + window - 1]]


def windows_around(batches: Iterator[pa.RecordBatch], block: int, window: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Windows that hold a hit block, packed by group. hs: two 64-bit hashes of the window; extra unused."""
    for b in slices(batches, 1):
        hit_rows = [i for i in range(b.num_rows) if b.column(2)[i].is_valid]
        if not hit_rows:
            continue
        b = b.take(pa.array(hit_rows))
        w, ids = Words(b.column(1)), _ids(b.column(0))
        h = _blocks(w, block, MULT_A)
        code = (_group_of(h, groups).astype(U) << U(32)) | (h & U(0xFFFFFFFF))
        at = []
        for i in range(b.num_rows):
            lo, hi = w.first[i], max(w.first[i], w.first[i + 1] - block + 1)
            at.append(lo + np.flatnonzero(np.isin(code[lo:hi], _codes(b.column(2), i))))
        s = _candidates(w, np.concatenate(at), block, window)
        if not len(s):
            continue
        a, c = rolling(w.hashes(MULT_A), window, MULT_A)[s], rolling(w.hashes(MULT_B), window, MULT_B)[s]
        who = ids[w.doc[s]]
        # of the windows of a slice with equal words only the smallest id is sent; the others are answered here
        order, run = _runs(who, c, a)
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = run[1:] != run[:-1]
        least = who[order][lead][run]
        behind = who[order] > least
        rows = []
        send = order[lead]
        pair = np.empty((len(send), 2), dtype=U)
        pair[:, 0], pair[:, 1] = a[send], c[send]
        back = np.argsort(who[send], kind="stable")
        rows += [(g, i, hs, b"") for g, i, hs, _ in _pack(_group_of(a[send][back], groups), who[send][back], pair[back], np.zeros(len(send), np.uint8))]
        if behind.any():
            # words covered by a window: its first hash names it to the document
            known = order[behind]
            rows += [(-1 - int(i) % groups, np.int64(i).tobytes(), code_, b"") for i, code_ in _by_id(who[known], a[known])]
        yield _emit(rows, _PACKED)


def _later(p: int, parts: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first hashes) of the windows that a smaller id has too."""
    if p < 0:
        hs = [np.frombuffer(x[1], np.uint64) for x in parts]
        return np.repeat(np.concatenate([np.frombuffer(x[0], np.int64) for x in parts]), [len(h) for h in hs]), np.concatenate(hs)
    ids = np.concatenate([np.frombuffer(x[0], np.int64) for x in parts])
    pair = np.concatenate([np.frombuffer(x[1], np.uint64) for x in parts]).reshape(-1, 2)
    order, run = _runs(ids, pair[:, 1], pair[:, 0])
    who = ids[order]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = run[1:] != run[:-1]
    behind = who > who[lead][run]
    return who[behind], pair[order[behind], 0]


def _grouped(packed: DataFrame, fn, groups: int) -> DataFrame:
    """(id, hits): fn on every group of probes, its answers dealt in packed form by id, then one row for each id."""

    def answer(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        ids, code = fn(p, list(zip(*(table.column(c).to_pylist() for c in ("ids", "hs", "extra")), strict=True)))
        to = (mix(ids.view(U)) % U(groups)).astype(np.int64)
        order = np.lexsort((ids, to))
        ids, code, to = ids[order], code[order], to[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        ends = list(zip([0, *cut], [*cut, len(to)], strict=True)) if len(to) else []
        return pa.table([pa.array([int(to[a]) for a, _ in ends], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([code[a:b].tobytes() for a, b in ends], pa.binary())], names=["d", "ids", "codes"])

    def collect(table: pa.Table) -> pa.Table:
        ids, code = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("codes", np.uint64)))
        rows = list(_by_id(ids, code))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "hits"])

    return packed.groupBy("p").applyInArrow(answer, "d long, ids binary, codes binary").groupBy("d").applyInArrow(collect, _HIT_DDL)


def _cut(w: Words, i: int, removed: np.ndarray) -> str:
    digest = hashlib.sha256()
    a = w.first[i]
    first = True
    keep = np.flatnonzero(~removed)
    for lo in range(0, len(keep), 100_000):
        part = keep[lo : lo + 100_000] + a
        digest.update((b"" if first else b" ") + b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[part], w.end[part], strict=True)))
        first = False
    return digest.hexdigest()


def _marks(w: Words, i: int, hits: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Which words of row i a window named by hits covers."""
    n = int(w.count[i])
    removed = np.zeros(n, dtype=bool)
    if n >= window and len(hits):
        a = w.first[i]
        s = np.flatnonzero(np.isin(h[a : a + n - window + 1], hits))
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
    return removed


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts dealt by id: id, text; (id, hits): the first hashes of the windows to remove)."""
    block = window // 2
    # one exchange for all three readings: each must see the same plan, so null ids are set aside here
    texts = _plain(docs, id_col, text_col).filter(F.col("id").isNotNull()).repartition("id")
    if groups is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        groups = max(16, min(1 << 30, -(-size // GROUP_BYTES)))
    packed = texts.mapInArrow(lambda it: probes(it, block, window, groups), _PACKED_DDL)
    hits = _grouped(packed, lambda p, parts: _hits(p, parts, groups), groups)
    around = texts.join(hits, "id").select("id", "text", "hits").mapInArrow(lambda it: windows_around(it, block, window, groups), _PACKED_DDL)
    return texts, _grouped(around, _later, groups)


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every document."""
    texts, later = removals(docs, window, id_col, text_col, groups)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] * keep_text)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1))
            h = None
            n_removed, digests, kept = [], [], []
            for i in range(b.num_rows):
                hits = _codes(b.column(2), i)
                if len(hits) and h is None:
                    h = rolling(w.hashes(MULT_A), window, MULT_A)
                removed = _marks(w, i, hits, h, window)
                n_removed.append(int(removed.sum()))
                digests.append(_cut(w, i, removed))
                if keep_text:
                    at = np.flatnonzero(~removed) + w.first[i]
                    kept.append(b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[at], w.end[at], strict=True)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.count), pa.array(n_removed, pa.int64()), pa.array(digests), *([pa.array(kept, pa.string())] * keep_text)], schema=schema)

    ddl = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    nameless = _plain(docs, id_col, text_col).filter(F.col("id").isNull()).withColumn("hits", F.lit(None).cast("binary"))
    out = texts.join(later, "id", "left").select("id", "text", "hits").mapInArrow(finish, ddl).union(nameless.mapInArrow(finish, ddl))
    return out.withColumnRenamed("id", id_col)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
