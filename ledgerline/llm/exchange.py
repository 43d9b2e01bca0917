"""Fixed-width records sent through Spark's shuffle as blobs, one per sender and receiving group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import bytewords as bw


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, and where each distinct one starts and ends in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return order, first, np.append(first[1:], len(keys))[: len(first)]


def dealt(to: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each receiver."""
    order, first, end = grouped(to)
    for a, b in zip(first, end, strict=True):
        yield int(to[order[a]]), records[order[a:b]].tobytes()


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in the column; one row at least."""
    _, offsets = bw.raw_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
