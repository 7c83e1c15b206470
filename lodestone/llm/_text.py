"""Vectorised word hashing shared by the text operators of this subpackage.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  All
separators are ASCII, so splitting the UTF-8 bytes is the same as splitting the
text.  A whole Arrow batch is hashed at once: one pass over its bytes finds the
words, one ``reduceat`` hashes them, and rolling hashes of k consecutive words
come from doubling, so the cost per byte does not depend on k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers of the two independent polynomial hashes (fixed values).
MULT_A, MULT_B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(mult: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and its inverse for i < n, kept per process."""
    have = _POWERS.get(int(mult))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = U(pow(int(mult), -1, 1 << 64))
        up, down = np.full(size, mult, dtype=U), np.full(size, inverse, dtype=U)
        up[0] = down[0] = U(1)
        have = _POWERS[int(mult)] = (np.cumprod(up), np.cumprod(down))
    return have


class Words:
    """Words of a batch of texts: ``start``/``end`` byte offsets into ``data``,
    ``doc`` the row of each word, ``first`` the first word of each row (n+1 entries)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.n, self.data, self.offsets = n, raw, off
        if not len(raw):
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
        else:
            word = ~_SEP[raw]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            inner = off[(off > 0) & (off < len(raw))]
            begins[inner] |= word[inner]  # a row's first word may touch the last word of the row before
            self.start = np.flatnonzero(begins)
            ends = np.zeros(len(raw) + 1, dtype=bool)
            ends[1:-1] = word[:-1] & ~word[1:]
            ends[-1] = word[-1]
            ends[inner] |= word[inner - 1]
            self.end = np.flatnonzero(ends)
            self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, mult: np.uint64 = MULT_A) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a difference of prefix sums, carried
        back to exponent 0 by the multiplier's inverse modulo 2**64."""
        if not len(self.start):
            return np.zeros(0, U)
        up, down = _powers(mult, len(self.data))
        with np.errstate(over="ignore"):
            sums = np.empty(len(self.data) + 1, dtype=U)
            sums[0] = 0
            np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=sums[1:])
            word = (sums[self.end] - sums[self.start]) * down[self.start]
            return mix(word + (self.end - self.start).astype(U) * MULT_B)

    def slice(self, i: int, lo: int, hi: int) -> bytes:
        """Bytes of words [lo, hi) of row i, one space between words."""
        a = self.first[i]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a + lo : a + hi], self.end[a + lo : a + hi], strict=True))


def rolling(h: np.ndarray, k: int, mult: np.uint64 = MULT_A) -> np.ndarray:
    """Hash of h[i:i+k] for each i with i+k <= len(h); order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out, have, power = None, 0, None
        block, width, block_power = h, 1, mult
        rest = k
        while True:
            if rest & 1:
                if out is None:
                    out, have, power = block, width, block_power
                else:  # out covers [i, i+have), block the width words after it
                    m = len(h) - have - width + 1
                    out = out[:m] * block_power + block[have : have + m]
                    have, power = have + width, power * block_power
            rest >>= 1
            if not rest:
                break
            m = len(block) - width
            block = block[:m] * block_power + block[width : width + m]
            width, block_power = width * 2, block_power * block_power
        return mix(out[:n])


def windows(words: Words, k: int, hashes: np.ndarray, mult: np.uint64 = MULT_A) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k-word window that lies in one row."""
    r = rolling(hashes, k, mult)
    at = np.flatnonzero(words.doc[: len(r)] == words.doc[k - 1 : k - 1 + len(r)]) if len(r) else np.zeros(0, np.int64)
    return at, r[at]
