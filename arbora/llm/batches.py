"""Arrow batches cut into pieces of bounded text size, so that a worker's memory does not follow a batch's row count."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to give back by hand
        return None


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers stay alive between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about max_bytes of the string column each (a single longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def texts(column: pa.Array) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of a column, one after another, and the n + 1 places where they begin and end (null as empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
