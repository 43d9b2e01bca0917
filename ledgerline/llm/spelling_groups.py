"""Spelling variants of the words of a corpus, by generating each word's whole neighbourhood.

Words are runs of letters, counted over all documents; a word belongs to the vocabulary from
``min_length`` code points and ``min_count`` occurrences on.

* Every word of the vocabulary emits all its distinct deletions, replacements and insertions
  over the letters that the vocabulary has.  They are made as 64-bit hashes, a whole block of
  words at a time: a rolling sum over the word gives the hash of each neighbour by one addition.
* A Bloom filter of the vocabulary (``FILTER_BITS`` bits, whatever the vocabulary's size) drops
  nearly all hashes that are no word.  It has no false negatives; when a vocabulary outgrows it,
  more candidates go on, none gets lost.
* What is left is spelled out and hash-joined to the vocabulary.  A candidate that is a word is
  near by construction: no distance is computed.  An edited word has one spelling in the list
  (deletions in a run of one letter count once, as do insertions beside an equal letter).

A word's form is its most frequent near word where that is ``ratio`` times as frequent or more;
forms are followed to the root by doubling the steps.

Defined cases: null and empty texts have no words; a null id counts as the empty id; repeated rows
count again; equally frequent near words: the first in code-point order; very long texts are read
in pieces cut between words, and very long words emit their neighbours in blocks; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .shared import giving_back, materialise

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: The contract's typing errors: one run in so many, by its hash, loses a letter.
TYPO_MODULUS = 199
#: Size of the filter: 8 MB on the driver and in each Python worker.
FILTER_BITS = 26
#: Bytes of text whose words are in memory at a time, and distinct words that a task counts before it hands them on.
PIECE, HELD = 4 << 20, 200_000
#: Neighbours that are in memory at a time.
BLOCK = 1 << 20

# U+00C0 to U+00FF are the bytes C3 80 to C3 BF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_P = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))


def _counted(typo_modulus: int | None, min_length: int):
    """Counts of the words of each task; bytes.lower() changes only A-Z."""

    def pieces(text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + PIECE)
            end = gap.end() if gap else len(text)
            yield text[at:end]
            at = end

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                salt = crc32(f"{doc_id.as_py() or ''}:".encode())
                for piece in pieces((text.as_py() or b"").lower()):
                    for run, n in Counter(_RUN.findall(piece)).items():
                        if typo_modulus and len(run) >= min_length and (h := crc32(run, salt)) % typo_modulus == 0:
                            letters = run.decode()
                            at = h % len(letters)
                            run = (letters[:at] + letters[at + 1 :]).encode()
                        if len(run) >= min_length:
                            total[run] += n
                if len(total) > HELD:
                    yield out(total)
                    total = Counter()
        yield out(total)

    return count


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_modulus: int | None = None) -> DataFrame:
    """word and n of all words of the corpus that are long and frequent enough."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("binary").alias("body"))
    counted = rows.mapInArrow(_counted(typo_modulus, min_length), "word string, n long")
    return counted.filter(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _STEP)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _slots(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that belong to each hash."""
    h = bw.mix(sums)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of one length, in blocks, and their code points as a matrix."""
    lengths = np.array([len(w) for w in words], np.int64)
    for size in np.unique(lengths):
        number = np.flatnonzero(lengths == size)
        rows = max(1, (1 << 16) // int(size))
        for lo in range(0, len(number), rows):
            part = number[lo : lo + rows]
            yield part, np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), size).astype(np.uint64)


def _filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the filter that the words set, and the letters they have (as code points below zero)."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        slots, letters = [np.zeros(0, np.int64)], set()
        for _, codes in _by_length(words):
            slots += _slots(((codes + np.uint64(1)) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))
            letters.update(np.unique(codes).tolist())
        slot = np.unique(np.concatenate(slots))
        word = np.concatenate([slot >> 6, -1 - np.array(sorted(letters), np.int64)])
        bits = np.concatenate([np.uint64(1) << (slot & 63).astype(np.uint64), np.zeros(len(letters), np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["place", "bits"])


def _filter(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The filter's bits and the letters of the vocabulary; both of bounded size."""
    found = words.select("word").mapInArrow(giving_back(_filter_rows), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    place, bits = (found.column(c).to_numpy() for c in ("place", "bits"))
    whole = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    whole[place[place >= 0]] = bits[place >= 0]
    return whole.view(np.uint64), np.sort(-1 - place[place < 0]).astype(np.uint64)


def _neighbours(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash sums of all distinct neighbours of words of one length: kind (-1 deleted, 0 replaced, 1 inserted), row, position, letter, sum."""
    n, size = codes.shape
    powers = _powers(size + 1)
    before = np.zeros((n, size + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers[:size], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(first)
    sums = before[:, :-1] + (whole - before[:, 1:]) * _BACK
    yield -1, row, at, np.zeros(len(row), np.uint64), sums[first]
    step = max(1, BLOCK // (n * len(letters)))
    for lo in range(0, size, step):
        old = codes[:, lo : lo + step, None]
        made = whole[:, :, None] + (letters - old) * powers[lo : lo + old.shape[1], None]
        row, at, letter = np.nonzero(letters != old)
        yield 0, row, at + lo, letters[letter], made[row, at, letter]
    for lo in range(0, size + 1, step):
        here = before[:, lo : lo + step]
        made = (here + (whole - here) * _STEP)[:, :, None] + (letters + np.uint64(1)) * powers[lo : lo + here.shape[1], None]
        fresh = np.ones(made.shape, bool)
        after = codes[:, lo : lo + step]
        fresh[:, : after.shape[1]] = letters != after[:, :, None]
        row, at, letter = np.nonzero(fresh)
        yield 1, row, at + lo, letters[letter], made[row, at, letter]


def _candidates(shared):
    """Each word with the neighbours that the filter lets through, spelled out."""

    @giving_back
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, letters = shared.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for number, codes in _by_length(words):
                for kind, row, at, letter, sums in _neighbours(codes, letters):
                    a, b = _slots(sums)
                    on = np.flatnonzero((bits[a >> 6] >> (a & 63).astype(np.uint64)) & (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1))
                    if not len(on):
                        continue
                    of = number[row[on]]
                    cut = 1 if kind <= 0 else 0
                    spelled = [(w := words[i])[:p] + (chr(c) if kind >= 0 else "") + w[p + cut :] for i, p, c in zip(of.tolist(), at[on].tolist(), letter[on].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in of], pa.string()), pa.array(counts[of]), pa.array(spelled, pa.string())], names=["word", "n", "near"])

    return emit


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for all pairs of words one edit apart, both ways; words is a stored table of word and n."""
    shared = words.sparkSession.sparkContext.broadcast(_filter(words))
    found = words.select("word", "n").mapInArrow(_candidates(shared), "word string, n long, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a stored vocabulary."""
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    about = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(about, "word", "left")
    is_form = F.col("best.near_n") >= ratio * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")))
    # Counts grow at least ratio-fold along forms, so paths are short and end; each round doubles the steps taken.
    reached = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("far"))
        stepped = materialise(reached.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return known.join(reached, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(materialise(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo_modulus=TYPO_MODULUS)))
