"""Small Arrow helpers of the mapInArrow / applyInArrow operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of an Arrow operator holds as Python objects.
STEP_BYTES = 4 << 20


def text_bytes(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to `size` bytes of the named column (a longer row alone)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
        width = column.type.value_type.bit_width // 8 if pa.types.is_list(column.type) else 1
        ends = np.cumsum(np.asarray(pc.fill_null(length(column), 0), np.int64) * width)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
