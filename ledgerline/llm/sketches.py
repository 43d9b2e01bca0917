"""Parities of sets: a bound on how much two sets differ that never lets a linked pair go."""

from __future__ import annotations

import numpy as np

from . import bytewords as bw

#: Bits of a set's parities.
PARITY = 2048


def parities(token: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, of which of its PARITY groups of shingles it has an odd number."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    odd = np.bincount(row * PARITY + (bw.mix(token ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PARITY)).astype(np.int64), minlength=n * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY), axis=1).view("<u8")


def parted(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether parities show that sets of these sizes differ in too many shingles for a link: they differ in no more bits than the sets do in shingles."""
    total = nx.astype(np.int64) + ny
    shared = -(-percent * total // (100 + percent))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) > total - 2 * shared


def wide_parities(token: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parities of each set over a number of bits that follows its size: the least power of two of two bits a shingle, PARITY at least."""
    n = np.diff(offsets)
    width = np.maximum(PARITY, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(width // 8))
    row = np.repeat(np.arange(len(n)), n)
    bit = (bw.mix(token ^ np.uint64(0x5851F42D4C957F2D)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    data = np.zeros(start[-1], np.uint8)
    np.bitwise_xor.at(data, start[row] + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    return [data[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]


class Wide:
    """Wide parities of some sets, compared at the lesser width of two: the halves of the wider one are added, which gives its parities over half the bits."""

    #: Bytes of parities compared at a time.
    STEP = 8 << 20

    def __init__(self, blobs: list[bytes]) -> None:
        self.size = np.array([len(b) for b in blobs], np.int64)
        self.levels = {}
        for size in np.unique(self.size).tolist():
            held = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            place = np.zeros(len(blobs), np.int64)
            place[held] = np.arange(len(held))
            words = np.zeros((len(held), size // 8), np.uint64)
            for at, i in enumerate(held.tolist()):
                words[at] = np.bitwise_xor.reduce(np.frombuffer(blobs[i], "<u8").reshape(-1, size // 8), axis=0)
            self.levels[size] = place, words

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sets x and y differ, never more than in shingles; 0 where one has more than twice the other's bits."""
        out = np.zeros(len(x), np.int64)
        size = np.minimum(self.size[x], self.size[y])
        near = np.maximum(self.size[x], self.size[y]) <= 2 * size
        for s in np.unique(size).tolist():
            place, words = self.levels[s]
            at = np.flatnonzero(near & (size == s))
            step = max(1, self.STEP // s)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                out[part] = np.bitwise_count(words[place[x[part]]] ^ words[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out
