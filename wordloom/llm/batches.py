"""Batches of texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are worked on side by side, and their bytes; a longer text is
#: worked on alone.
ROWS, BYTES = 2_000, 4_000_000


def parts_of(batch: pa.RecordBatch, column: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most so many rows and bytes of text."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(length)
    begin = 0
    while begin < len(length):
        before = upto[begin - 1] if begin else 0
        end = int(np.searchsorted(upto, before + size, side="right"))
        end = min(max(end, begin + 1), begin + rows, len(length))
        yield batch.slice(begin, end - begin)
        begin = end
