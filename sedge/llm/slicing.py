"""Arrow batches cut by bytes of text, so that a task's arrays have a bounded size whatever a batch holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 4 << 20


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of at most ``part_bytes`` in the given column, or of one row that has more."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        begin = 0
        while begin < len(size):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + part_bytes, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
