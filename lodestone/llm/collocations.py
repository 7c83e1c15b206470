"""Phrase collocations: merged count-min sketches, exact counts of survivors, scores, subsumption.

Texts are lower-cased (A-Z only) and cut into pieces at ``.,;:!?`` and line ends, pieces
into words at blanks and tabs.  Everything is counted per language.

First pass: a task hashes every phrase of up to four words into two lines of ``2**CELL_BITS``
cells, and writes its counts (cells that it met, packed by ranges of cells).  Merging two
sketches adds their counts, so ranges are merged by key, in several steps if many tasks met
one.  A cell's sum is at least the count of any phrase in it: a phrase whose cell is below
the least count in either line cannot be frequent.  What a task of the second pass is sent is
one bit for each cell, 2 * 2**CELL_BITS / 8 bytes at most whatever the input.

Second pass: a phrase survives if both its cells are frequent and both phrases that are one
word shorter survive.  Survivors are counted exactly: words are numbered by an exact
dictionary, phrases by pairs of numbers; counts are added up in the task, packed, added up
again by ranges of phrases, and then by the phrase itself.  All parts of a frequent phrase are at least as frequent, so every count that a
score needs is there.  Larger inputs fill the cells more; that makes more survivors, and no
frequent phrase is lost.

Defined results: a null text is an empty one and a null language is ``und``, as are rows that
say so; repeated rows count each time; an empty table gives no rows; ties are ordered by the
phrase; other columns are ignored.  A text is held whole in one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch
from lodestone.llm._text import MULT_A, MULT_B, U, _powers, mix
from lodestone.llm.batches import slices

MOST_WORDS, LEAST, TOP, SCALE, SUBSUMED = 4, 30, 2000, 2_000_000, (100, 80)
CELL_BITS, RANGE_BITS = 28, 20
SLICE = 2 << 20  # bytes of text at once
PENDING = 3 << 20  # cells of a line that a task holds before it writes them
ENTRIES = 400_000  # survivors of which a task adds up the counts before it hands them on
RANGES = 64  # of survivors at least, each added up by one task before they meet by phrase
STEP = 1000  # packed ranges that one task merges
UNKNOWN = "und"
_PIECES = 64  # of a language's phrases, each ranked alone before they meet
_DEALT = 16  # copies of the one-word counts, for words that begin or end very many phrases
_TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WIDEST = (1 << 16) - 1
_CODEC = "zstd"


class Phrases:
    """The words of a batch: ``word`` numbers into ``lexicon``, ``piece`` and ``doc`` of each."""

    def __init__(self, column: pa.Array):
        column = column.fill_null(b"").cast(pa.large_binary())
        rows = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
        raw = bytes(column.buffers()[2][int(off[0]) : int(off[-1])]) if off[-1] > off[0] else b""
        data, off = np.frombuffer(raw.translate(_TABLE), np.uint8), off - off[0]
        self.sizes = np.diff(off)
        breaks = data == 10
        letter = ~(breaks | (data == 32))
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        ends[:-1] &= ~letter[1:]
        inner = off[(off > 0) & (off < len(data))]  # a text may begin within what looks like one word
        begins[inner] |= letter[inner]
        ends[inner - 1] |= letter[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(off, start, side="right") - 1
        self.piece = np.cumsum(breaks)[start] + self.doc if len(start) else start  # both only grow
        places = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data[letter])]).dictionary_encode()
        self.lexicon, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)

    def hashes(self, language: np.ndarray) -> list[np.ndarray]:
        """64-bit hashes of the phrases of 1, 2, ... words at each word, of its language too; some reach over the end of a piece."""
        n = len(self.lexicon)
        if not n:
            return [np.zeros(0, U)] * MOST_WORDS
        off = np.frombuffer(self.lexicon.buffers()[1], np.int64)[self.lexicon.offset : self.lexicon.offset + n + 1]
        data = np.frombuffer(self.lexicon.buffers()[2], np.uint8)[: off[-1]]
        up, down = _powers(MULT_A, len(data))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])
            word = mix((sums[off[1:]] - sums[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(U) * MULT_B)
            one = mix(word[self.word] + language[self.doc])
            out = [one]
            for k in range(1, MOST_WORDS):
                m = max(0, len(one) - k)
                out.append(mix(out[-1][:m] * MULT_A + one[k : k + m] * MULT_B))
        return out

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one piece."""
        m = max(0, len(self.piece) - k + 1)
        return self.piece[:m] == self.piece[k - 1 : k - 1 + m]


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, number of each row, hash of each row)."""
    coded = column.fill_null(UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = np.array([int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") for n in names], U)
    return names, (at := coded.indices.to_numpy().astype(np.int64)), seeds[at]


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of hashes in the two lines: two stretches of their bits that do not overlap for 32 bits or less."""
    return (h >> U(64 - bits)).astype(np.uint32), (h & U((1 << bits) - 1)).astype(np.uint32)


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells of a range and their counts, as gaps, byte by byte of all numbers."""
    gaps = np.diff(cells, prepend=cells.dtype.type(0)).astype(np.uint32)
    planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(counts, _WIDEST).astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes()
    return len(cells).to_bytes(4, "little") + pa.compress(planes, _CODEC, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 6 * n, _CODEC, asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(planes[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps), np.ascontiguousarray(planes[4 * n :].reshape(2, n).T).view(np.uint16).ravel()


def _pack_phrases(phrases: list[bytes], times: list[int]) -> bytes:
    """Phrases, which hold no line end, and their counts."""
    raw = b"\n".join(phrases)
    return len(phrases).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(np.array(times, np.int64).tobytes() + raw, _CODEC, asbytes=True)


def _unpack_phrases(blob: bytes) -> Iterator[tuple[bytes, int]]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw = pa.decompress(blob[8:], 8 * n + size, _CODEC, asbytes=True)
    return zip(raw[8 * n :].split(b"\n"), np.frombuffer(raw[: 8 * n], np.int64).tolist(), strict=True)


_SKETCH = pa.schema([("line", pa.int32()), ("range", pa.int32()), ("packed", pa.binary())])


def sketch(docs: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """(line, range, packed): the count-min sketches of the tasks over docs (lang, text as bytes), in pieces of 2**RANGE_BITS cells."""
    width = min(bits, RANGE_BITS)

    def flush(line: int, held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        cells, counts = cells[start], np.diff(np.append(start, len(cells)))
        of = cells >> np.uint32(width)
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
        inside = cells & np.uint32((1 << width) - 1)
        packed = [_pack(inside[a:b], counts[a:b]) for a, b in zip(cut, [*cut[1:], len(cells)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([line] * len(cut), pa.int32()), pa.array(of[cut].astype(np.int32)), pa.array(packed, pa.binary())], schema=_SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        n = 0
        for b in slices(batches, 1, SLICE):
            p = Phrases(b.column(1))
            for k, h in enumerate(p.hashes(_languages(b.column(0))[2]), 1):
                for line, cells in enumerate(_cells(h[p.within(k)], bits)):
                    if len(cells):
                        held[line].append(cells)
                        n += len(cells) * (not line)
            if n >= PENDING:
                for line in (0, 1):
                    yield flush(line, held[line])
                    held[line].clear()
                n = 0
        for line in (0, 1):
            if held[line]:
                yield flush(line, held[line])

    return docs.select("lang", "text").mapInArrow(run, "line int, range int, packed binary")


def _merged(parts: DataFrame, keys: list[str], bits: int, least: int | None = None) -> DataFrame:
    """(line, range, packed): the parts of each key added up; with ``least``, one bit for each cell that reaches it."""
    width = min(bits, RANGE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def made() -> pa.RecordBatch:
            if least is None:
                cells = np.flatnonzero(sums).astype(np.uint32)
                packed = _pack(cells, sums[cells])
            else:
                packed = pa.compress(np.packbits(sums >= min(least, _WIDEST), bitorder="little").tobytes(), _CODEC, asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed], pa.binary())], schema=_SKETCH)

        for b in batches:
            for key, blob in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True), b.column(len(keys)).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield made()
                    now, sums = key, np.zeros(1 << width, np.int64)
                cells, counts = _unpack(blob)
                sums[cells] += counts  # a part holds a cell once
        if now is not None:
            yield made()

    return parts.select(*keys, "packed").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "line int, range int, packed binary")


def frequent_cells(docs: DataFrame, scratch: Scratch, least: int = LEAST, bits: int = CELL_BITS) -> dict[tuple[int, int], bytes]:
    """(line, range) to the packed bits of the cells whose merged count is ``least`` or more: 2 * 2**bits / 8 bytes at most."""
    parts = scratch.table(sketch(docs, bits), "sketch")
    of_range = parts.count() / (2 << max(0, bits - RANGE_BITS))
    while of_range > STEP:
        pieces = max(1, int(of_range / STEP))
        dealt = parts.withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.lit(pieces)))
        merged = scratch.table(_merged(dealt, ["line", "range", "piece"], bits), "sketch")
        scratch.drop(parts)
        parts, of_range = merged, pieces
    return {(r.line, r.range): bytes(r.packed) for r in _merged(parts, ["line", "range"], bits, least).collect()}


_BITMAPS: dict[str, list[np.ndarray]] = {}


def _bitmaps(token: str, sent: dict[tuple[int, int], bytes], bits: int) -> list[np.ndarray]:
    """The two bitmaps of a broadcast, unpacked once a worker."""
    if token not in _BITMAPS:
        _BITMAPS.clear()
        step = max(1, (1 << min(bits, RANGE_BITS)) // 8)
        out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in (0, 1)]
        for (line, of), packed in sent.items():
            out[line][of * step : (of + 1) * step] = np.frombuffer(pa.decompress(packed, step, _CODEC, asbytes=True), np.uint8)
        _BITMAPS[token] = out
    return _BITMAPS[token]


def _hit(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, bits: int = CELL_BITS) -> DataFrame:
    """(lang, size, phrase, f): exact counts of all phrases of 1 to 4 words that occur ``least`` times or more; size 0: all words."""
    cells = frequent_cells(docs, scratch, least, bits)
    token, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(cells)
    step = max(1, (1 << min(bits, RANGE_BITS)) // 8)
    frequent = sum(int(np.bitwise_count(np.frombuffer(pa.decompress(c, step, _CODEC, asbytes=True), np.uint8)).sum()) for (line, _), c in cells.items() if not line)
    dealt = max(RANGES, frequent >> 16)

    def packed(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, phrases in held.items():
            by: dict[int, list[bytes]] = {}
            for p in phrases:
                by.setdefault(zlib.crc32(p) % dealt, []).append(p)
            blobs = [_pack_phrases(ps, [phrases[p] for p in ps]) for ps in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(by), pa.string()), pa.array(list(by), pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "range", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, held = _bitmaps(token, sent.value, bits), {}
        for b in slices(batches, 1, SLICE):
            p = Phrases(b.column(1))
            names, lang, seeds = _languages(b.column(0))
            of = lang[p.doc]
            counted = [held.setdefault(n, {}) for n in names]
            for i, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                counted[i][b""] = counted[i].get(b"", 0) + n
            lexicon, before, number = p.lexicon.to_pylist(), np.ones(len(p.word) + 1, bool), of
            for k, h in enumerate(p.hashes(seeds), 1):
                m = len(h)
                at = np.flatnonzero(p.within(k) & before[:m] & before[1 : m + 1])
                for line in (0, 1):
                    at = at[_hit(maps[line], _cells(h[at], bits)[line])]
                key = number[at] * len(lexicon) + p.word[at + k - 1]
                _, first, dense, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                before, number = np.zeros(m, bool), np.zeros(m, np.int64)
                before[at], number[at] = True, dense
                where = at[first]
                for s, w, n in zip(of[where].tolist(), zip(*(p.word[where + j].tolist() for j in range(k)), strict=True), times.tolist(), strict=True):
                    one = b" ".join([lexicon[x] for x in w])
                    counted[s][one] = counted[s].get(one, 0) + n
            if sum(map(len, held.values())) >= ENTRIES:
                yield from packed(held)
                held = {}
        yield from packed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a language and range added up, handed on when there are very many."""
        now, held = None, {}

        def batch() -> pa.RecordBatch:
            keys = list(held)
            sizes = [k.count(b" ") + 1 if k else 0 for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(keys), pa.string()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "size", "phrase", "f"])

        for b in batches:
            for key, blob in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                if held and (key != now or len(held) >= ENTRIES):
                    yield batch()
                    held.clear()
                now = key
                for p, n in _unpack_phrases(blob):
                    held[p] = held.get(p, 0) + n
        if held:
            yield batch()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, range int, packed binary")
    found = parts.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(add, "lang string, size int, phrase binary, f long")
    sums = found.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return scratch.table(sums.filter(f"size = 0 OR f >= {int(least)}"), "counts")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _with_part(cuts: DataFrame, found: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of a part of the phrase; counts of single words are dealt out, as one may stand in very many phrases."""
    dealt = lambda words, by: F.when(words, by).otherwise(F.lit(0))
    sides = found.filter("size > 0").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), dealt(F.col("size") == 1, F.lit(_DEALT - 1)))).alias("p_piece"))
    piece = dealt(F.instr(part, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(_DEALT)).cast("int"))
    on = (F.col("lang") == F.col("p_lang")) & (F.col(part) == F.col("p_phrase")) & (F.col("piece") == F.col("p_piece"))
    return cuts.withColumn("piece", piece).join(sides, on).drop("p_lang", "p_phrase", "p_piece", "piece")


def scored(found: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of the phrases of two words and more: the lowest-scoring cut."""
    phrases = found.filter("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = _with_part(_with_part(cuts, found, "head", "l"), found, "tail", "r")
    score = F.expr(f"(CAST(a AS decimal(19,0)) * CAST({SCALE} AS decimal(7,0))) div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))")
    return cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "size", "phrase", "a", "c.l", "c.r", "c.score")


def subsumed(found: DataFrame) -> DataFrame:
    """(lang, phrase): phrases of which nearly all occurrences are within those of one longer phrase."""
    longer = found.filter("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))"))
    most = longer.select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    times, share = SUBSUMED
    held = found.filter("size > 1").join(most.hint("merge"), ["lang", "phrase"])
    return held.filter(_exact("most") * F.lit(times).cast("decimal(7,0)") >= _exact("f") * F.lit(share).cast("decimal(7,0)")).select("lang", "phrase")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, bits: int = CELL_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations", sweep=True)
    plain = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = counts(plain, scratch, least, bits)
    kept = scored(found).join(subsumed(found).hint("merge"), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = kept.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(_PIECES))).withColumn("place", place("lang", "piece")).filter(F.col("place") <= top)
    best = first.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= top)
    words = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    times, share = SUBSUMED
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k AS size, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= {LEAST}),
x AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT x.*, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
j AS (SELECT lang, a, ws, size, unnest(range(2, size)) AS m FROM c),
i AS (SELECT lang, a, ws, m, unnest(range(1, size - m + 2)) AS i FROM j),
u AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM i GROUP BY ALL),
o AS (SELECT b.*, t.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b JOIN t ON t.lang = b.lang
  LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE u.most IS NULL OR {times}::HUGEINT * u.most < {share}::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= {TOP}"""
