"""Stretches of numpy arrays as binary columns: a few rows for a batch instead of one for each number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of values, from each start to the next, as a binary column."""
    width = values.dtype.itemsize
    offsets = (np.r_[starts, len(values)] * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def ends_of(starts: np.ndarray, n: int) -> np.ndarray:
    """Where the stretches that begin at starts end, of n in all."""
    return np.r_[starts[1:], n].astype(np.int64) if len(starts) else np.zeros(0, np.int64)


def pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(data: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for d in dtypes:
        kind = np.dtype(d)
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def rows(names: list[str], kinds: list[pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
