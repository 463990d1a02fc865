"""Many numbers as one binary value: few rows, and less to shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, so that high bytes, mostly zero, compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def rows_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
