"""Vectorised word and shingle hashing over the UTF-8 buffer of an Arrow string column.

A word is a run of bytes outside 0x20 and 0x09-0x0D, so a UTF-8 character is never
cut.  Each word gets a 64-bit polynomial hash of its bytes, computed for a whole
batch at once from one prefix sum; no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, up to n at least."""
    for k, base in enumerate((_P, _P_INV)):
        if len(_powers[k]) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and where each row starts (n + 1 offsets); a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    up, down = _grow(1 << 16)
    hashes = np.empty(len(start), np.uint64)
    # Pieces of bounded length: prefix sums wrap, powers stay in one table.
    piece = (1 << 16) - 1
    lo = 0
    while lo < len(start):
        base = start[lo]
        hi = int(np.searchsorted(end, base + piece, side="right"))
        if hi <= lo:  # one word longer than a piece
            hashes[lo] = _long_word(data[base : end[lo]], lower)
            lo += 1
            continue
        part = data[base : end[hi - 1]]
        part = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        hashes[lo:hi] = (total[e] - total[s]) * down[s]
        lo = hi
    return mix(hashes)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals made small."""
    low = _LOWER[data]
    if len(data) > 1:
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[capital] += 0x20
    return low


#: Bytes that are no part of a token of letters and digits; bytes of longer characters are part of it.
NO_TOKEN = np.ones(256, dtype=bool)
NO_TOKEN[48:58] = NO_TOKEN[65:91] = NO_TOKEN[97:123] = NO_TOKEN[128:] = False


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the batch: its row, first byte, end byte and hash."""
    row = np.zeros(0, np.int64)
    if not len(data):
        return row, row, row, np.zeros(0, np.uint64)
    inside = ~blank[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(cuts):
        before = cuts[cuts > 0] - 1
        last[before] |= inside[before]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end, hash_spans(data, start, end, lower)


def _long_word(part: np.ndarray, lower: bool) -> np.uint64:
    part = _LOWER[part] if lower else part
    up, _ = _grow(1 << 16)
    value, step = 0, pow(_P, len(up) - 1, 1 << 64)
    scale = 1
    for k in range(0, len(part), len(up) - 1):
        block = part[k : k + len(up) - 1].astype(np.uint64) + np.uint64(1)
        value = (value + scale * int((block * up[: len(block)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * step % (1 << 64)
    return np.uint64(value)


def shingles(row: np.ndarray, hashes: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each k-word shingle; a row with 1 to k - 1 words has its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(count)
    starts = ends - count
    mul = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    m = max(0, len(hashes) - k + 1)
    value = np.zeros(m, np.uint64)
    for j in range(k):
        value = value * mul[0] + hashes[j : j + m]
    whole = (row[:m] == row[k - 1 :]) if m else np.zeros(0, bool)
    out_row, out_hash = row[:m][whole], mix(value[whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for r in short:
            v = 0
            for h in hashes[starts[r] : ends[r]]:
                v = (v * int(mul[0]) + int(h)) % (1 << 64)
            extra.append((v + int(count[r]) * 0xA0761D6478BD642F) % (1 << 64))
        out_row = np.concatenate([out_row, short])
        out_hash = np.concatenate([out_hash, mix(np.array(extra, np.uint64))])
    return out_row, out_hash


def distinct_sets(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, one row after another, and n_rows + 1 offsets."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]).astype(np.int64)
