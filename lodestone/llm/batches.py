"""Small slices of Arrow batches, so that memory follows one slice and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts or bytes (column ``text``) have about ``most`` bytes; a longer row is a slice of its own."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        column = b.column(text)
        lengths = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset : lengths.offset + n + 1])
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(lo, hi - lo)
