"""Benchmark decontamination by spaced seeds.

Each fixed mask hashes the tokens at its ones and ignores those at its zeros, so a
substituted token leaves some seed of an overlap whole.  Seeds of the documents are
looked up among the seeds of the test items; every hit fixes an alignment of document
and item, along which the best stretch with at least four in five tokens equal is found.
A document is contaminated if that stretch has MIN_MATCHED equal tokens, or the share
MIN_SHARE of a shorter item.

The test items are taken in blocks of at most BLOCK_TOKENS tokens; a block's index is
what each task holds.  Documents are read once per block and never shuffled.

Defined cases: null or empty texts and items have no tokens and never match, nor
do items with fewer tokens than the shortest mask, which any text may hold; repeated documents or items each
give their rows; empty tables give no rows; other columns are not read, or kept as they are
by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bytewords as bw
from .exchange import slices
from .shared import giving_back

# The masks.
MASKS = ("11111", "1101011", "110010111", "1011001011")
MIN_MATCHED, MIN_SHARE = 13, 0.8
#: A mismatch costs as much as four matches earn: stretches keep four in five tokens equal.
MISMATCH = 4
BLOCK_TOKENS = 2_000_000
#: Slots of the table that first sifts the seeds of documents.
SIFT_BITS = 22
#: Hits whose alignments are in memory at a time, about.
HITS = 1_000_000


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows one after another, and n + 1 offsets."""
    data, offsets = bw.raw_bytes(column)
    row, _, _, hashes = bw.words(bw.folded(data), offsets, blank=bw.NO_TOKEN)
    n = len(offsets) - 1
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    span = len(mask)
    m = max(0, len(hashes) - span + 1)
    out = np.full(m, len(mask) * 0x9E37 + int(mask, 2), np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            out = out * np.uint64(0x100000001B3) + hashes[k : k + m]
    return bw.mix(out)


class SeedIndex:
    """The seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.tokens, self.offsets = _tokens(pa.array([t for _, t in items], pa.string()))
        item = np.repeat(np.arange(len(items)), np.diff(self.offsets))
        keys, places = [], []
        for mask in MASKS:
            s = _seeds(self.tokens, mask)
            whole = np.flatnonzero(item[: len(s)] == item[len(mask) - 1 :]) if len(s) else np.zeros(0, np.int64)
            keys.append(s[whole])
            places.append(whole)
        key, place = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]
        self.sift = np.zeros(1 << SIFT_BITS, bool)
        self.sift[(self.key >> np.uint64(64 - SIFT_BITS)).astype(np.int64)] = True

    def find(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, matched, stretch, share) of each row and item that overlap enough; the longest overlap of the two."""
        tokens, offsets = _tokens(column)
        if not len(tokens) or not len(self.key):
            return []
        spots, lefts, rights = [], [], []
        for mask in MASKS:
            s = _seeds(tokens, mask)
            at = np.flatnonzero(self.sift[(s >> np.uint64(64 - SIFT_BITS)).astype(np.int64)])
            left, right = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            hit = right > left
            spots.append(at[hit])
            lefts.append(left[hit])
            rights.append(right[hit])
        spot, left, right = np.concatenate(spots), np.concatenate(lefts), np.concatenate(rights)
        # In order of their place in the texts, so many hits at a time: a seed that both sides have often takes time, not memory.
        order = np.argsort(spot, kind="stable")
        spot, left, many = spot[order], left[order], (right - left)[order]
        ends = np.cumsum(many)
        best: dict[tuple[int, int], tuple[int, int, float]] = {}
        lo = 0
        while lo < len(spot):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, side="right")))
            self._align(tokens, offsets, spot[lo:hi], left[lo:hi], many[lo:hi], best)
            lo = hi
        return [(r, i, *v) for (r, i), v in best.items()]


    def _align(self, tokens: np.ndarray, offsets: np.ndarray, spot: np.ndarray, left: np.ndarray, many: np.ndarray, best: dict) -> None:
        """Puts the longest overlap of each row and item along the alignments of these hits into best, if it is long enough."""
        place = self.place[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        spot = np.repeat(spot, many)
        item = np.searchsorted(self.offsets, place, side="right") - 1
        row = np.searchsorted(offsets, spot, side="right") - 1
        lines = np.unique(np.stack([row, item, spot - place]), axis=1)
        for r, i, shift in lines.T.tolist():
            a, b = self.offsets[i : i + 2]
            lo, hi = max(a, offsets[r] - shift), min(b, offsets[r + 1] - shift)
            if hi <= lo:
                continue
            matched, length = _stretch(tokens[lo + shift : hi + shift] == self.tokens[lo:hi])
            if matched >= min(MIN_MATCHED, MIN_SHARE * (b - a)) and matched > best.get((r, i), (0,))[0]:
                best[r, i] = (matched, length, matched / float(b - a))


def _stretch(equal: np.ndarray) -> tuple[int, int]:
    """Equal tokens and length of the stretch with the most equal tokens of those with at least four in five equal; the shortest of equals."""
    # A stretch has four in five tokens equal if its sum of 1 a match and -MISMATCH a mismatch is not negative: for each end, the first start with no higher sum before it.
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    count = np.concatenate([[0], np.cumsum(equal)])
    start = np.searchsorted(-np.minimum.accumulate(score), -score, side="left")
    matched = count - count[start]
    # Mismatches at the ends add nothing: only from the first match to the last.
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0
    most = np.flatnonzero(matched == matched.max())
    length = hits[count[most] - 1] + 1 - hits[count[start[most]]]
    return int(matched.max()), int(length.min())


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    """Blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for r in benchmark.select(item_id, text).orderBy(item_id, text).toLocalIterator():
        n = len((r[1] or "").split())
        if block and size + n > BLOCK_TOKENS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: matched tokens, length of the stretch, share of the item."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, matched int, stretch int, item_share double"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text):
        found = found.union(docs.select(doc_id, text).mapInArrow(_finder(block, schema_of(docs, doc_id), schema_of(benchmark, item_id)), schema))
    return found


def schema_of(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _finder(block: list, doc_type: pa.DataType, item_type: pa.DataType):
    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SeedIndex(block)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = index.find(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([r[0] for r in rows], pa.int64())).cast(doc_type),
                        pa.array([index.ids[r[1]] for r in rows], item_type),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.array([r[4] for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "matched", "stretch", "item_share"],
                )

    return scan


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the contaminated ones; all columns stay and nothing is shuffled."""
    at = docs.columns.index(text)

    def sieve(block: list):
        @giving_back
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(block)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                lo = 0
                for part in slices(batch, at, 4 << 20):
                    for r in index.find(part.column(at)):
                        keep[lo + r[0]] = False
                    lo += part.num_rows
                yield batch.filter(pa.array(keep))

        return scan

    for block in _blocks(benchmark, item_id, item_text):
        docs = docs.mapInArrow(sieve(block), docs.schema)
    return docs


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
