"""Fill-in-middle transformation by a table-driven byte automaton.

One automaton reads the bytes of a text once.  Its state is the product of three small
machines: how many UTF-8 continuation bytes are still due, which prefix of a sentinel was
just read (a trie with failure links), and whether the last byte was inside a word.  A
transition emits marks: a code point begins here, a unit ended before this byte, a sentinel
ends here.  All three machines forget: after ``memory`` bytes the state no longer depends
on the state before, so a batch is cut into lanes that start that many bytes early and all
lanes advance together, one table lookup for each byte.  Counted marks give the number of
units; a second pass over the marks finds the byte and code point of each cut.

A unit is a word with the separators before it (separators: space and 9 to 13), or the
separators at the end.  Cuts, rate and form of a document come from sha256("seed:id").

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel,
is left plain; a null id is hashed as ``\\N``; repeated rows give a row each with the same
result; a stray continuation byte counts as a code point; an empty table gives no rows;
other columns pass through ``transform`` whatever their names.  A text is held whole in one
task, and its marks take some ten times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._names import fresh
from lodestone.llm.batches import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80  # percent of texts that are transformed, and of those that put the suffix first
CODE_POINT, UNIT, SENTINEL = 1, 2, 4  # marks of a transition
_LANES = 2048
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


class Automaton:
    """The tables: ``classes`` of the 256 bytes and of RESET, ``step`` and ``marks`` by (state, class)."""

    RESET = 256

    def __init__(self, sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)):
        words = [s.encode() for s in sentinels]
        if not all(words):
            raise ValueError("a sentinel is empty")
        nodes = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(nodes)}
        ends = [any(p.endswith(w) for w in words) for p in nodes]

        def follow(p: bytes, b: int) -> int:
            q = p + bytes([b])
            while q not in number:
                q = q[1:]
            return number[q]

        self.memory = max(3, *map(len, words))
        state = lambda due, node, inside: (due * len(nodes) + node) * 2 + inside
        self.start = state(0, 0, 0)
        signature = {}
        for b in range(256):
            due = 1 if 0xC0 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if b >= 0xF0 else 0
            signature[b] = (due, 0x80 <= b < 0xC0, b in _SPACES, b if any(b in w for w in words) else -1)
        kinds = sorted(set(signature.values()))
        self.classes = np.array([kinds.index(signature[b]) for b in range(256)] + [len(kinds)], np.uint8)
        self.width = len(kinds) + 1
        count = state(3, len(nodes) - 1, 1) + 1
        self.step = np.full((count, self.width), self.start, np.int32)
        self.marks = np.zeros((count, self.width), np.uint8)
        for due in range(4):
            for k, p in enumerate(nodes):
                for inside in (0, 1):
                    at = state(due, k, inside)
                    for c, (more, continues, space, b) in enumerate(kinds):
                        node = follow(p, b) if b >= 0 else 0
                        held = continues and due > 0
                        self.step[at, c] = state(due - 1 if held else more, node, int(not space))
                        self.marks[at, c] = CODE_POINT * (not held) + UNIT * (inside and space) + SENTINEL * ends[node]
        self.step, self.marks = self.step.ravel() * self.width, self.marks.ravel()  # a state is the place of its row

    def scan(self, symbols: np.ndarray) -> np.ndarray:
        """The marks of each symbol (classes of bytes); a RESET is in the start state after it."""
        n = len(symbols)
        length = max(4 * self.memory, -(-n // _LANES))
        lanes = max(1, -(-n // length))
        padded = np.full(self.memory + lanes * length, self.classes[self.RESET], np.uint8)
        padded[self.memory : self.memory + n] = symbols
        at = np.arange(lanes) * length
        table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.memory + length)[at].T)
        state = np.full(lanes, self.start * self.width, np.int32)
        for row in table[: self.memory]:
            state = self.step[state + row]
        out = np.empty((length, lanes), np.uint8)
        for k, row in enumerate(table[self.memory :]):
            edge = state + row
            out[k] = self.marks[edge]
            state = self.step[edge]
        return np.ascontiguousarray(out.T).ravel()[:n]


def _draws(ids: list[str | None], seed: int) -> np.ndarray:
    """The first four 32-bit numbers of sha256("seed:id") of each row."""
    raw = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, 4)


def _arrange(column: pa.Array, ids: list, automaton: Automaton, tags: tuple[bytes, bytes, bytes], seed: int, rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of each text of a batch."""
    column = column.fill_null(b"").cast(pa.large_binary())
    rows = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    size = np.diff(off)
    begin = off[:-1] + np.arange(rows) + 1  # in the symbols, of which one before each text resets
    symbols = np.full(len(raw) + rows, automaton.classes[automaton.RESET], np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[begin - 1] = False
    symbols[inside] = automaton.classes[raw]
    marks = automaton.scan(symbols)
    units = np.flatnonzero(marks & UNIT)  # a unit ended before this symbol
    first, last = np.searchsorted(units, begin), np.searchsorted(units, begin + size)
    n = last - first + (size > 0)
    found = np.flatnonzero(marks & SENTINEL)
    plain = (size == 0) | (np.searchsorted(found, begin + size) > np.searchsorted(found, begin))
    h = _draws(ids, seed)
    plain |= h[:, 2] % 100 >= rate
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    points = np.concatenate([[0], np.cumsum(marks & CODE_POINT)])  # CODE_POINT is 1

    def place(k: np.ndarray) -> np.ndarray:
        """The symbol at which the k-th unit of each text ends."""
        if not len(units):
            return np.where(k == 0, begin, begin + size)
        at = units[np.minimum(first + np.maximum(k, 1) - 1, len(units) - 1)]
        return np.where(k == 0, begin, np.where(k >= n, begin + size, at))

    a, b = place(cuts[:, 0]), place(cuts[:, 1])
    spm = h[:, 3] % 100 < spm_rate
    p, s, m = tags
    data, out = raw.tobytes(), []
    for i in range(rows):
        lo, hi = int(off[i]), int(off[i + 1])
        if plain[i]:
            out.append(data[lo:hi])
            continue
        x, y = lo + int(a[i] - begin[i]), lo + int(b[i] - begin[i])
        out.append(b"".join((s, data[y:hi], p, data[lo:x], m, data[x:y]) if spm[i] else (p, data[lo:x], s, data[y:hi], m, data[x:y])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(points[a] - points[begin], pa.int64(), mask=plain),
        pa.array(points[b] - points[a], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string(), safe=False),
    ]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """docs with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, one row per row, without a
    shuffle; a column of docs that has such a name keeps it, and the new one gets underscores.
    sentinels: of prefix, suffix and middle; none may begin with the end of another."""
    names = fresh(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    tags = tuple(s.encode() for s in sentinels)
    borders = any(x[-k:] == y[:k] for x in tags for y in tags for k in range(1, min(len(x), len(y)) + (x != y)))
    if borders or any(tags[i] in tags[j] for i in range(3) for j in range(3) if i != j):
        raise ValueError("sentinels overlap: an output could be read in two ways")
    automaton, width = Automaton(sentinels), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, width + 1):
            made = _arrange(b.column(width + 1), [i or "\\N" for i in b.column(width).to_pylist()], automaton, tags, seed, rate, spm_rate)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=[*(f"c{i}" for i in range(width)), *names])

    numbered = docs.toDF(*(f"c{i}" for i in range(width)))
    of = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    ready = numbered.select("*", F.col(of[id_col.lower()]).cast("string").alias("key"), F.col(of[text_col.lower()]).cast("string").cast("binary").alias("bytes"))
    types = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), *(f"`{k}` {t}" for k, t in zip(names, ("long", "string", "long", "long", "string"), strict=True))])
    return ready.mapInArrow(run, types).toDF(*docs.columns, *names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels))  # '', then the parts in the order of the form
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same in DuckDB, with the units taken by the regular expression that defines them."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '\N')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256 FROM p"""
