"""Alignment of two tokenizers over the same bytes, with packed bitsets of token ends.

Each text, with a space before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer
(B).  Over a block of texts, two bitsets mark the bytes at which a token of A or of B ends; their
AND is the set of shared cuts.  The set bits of each word select the cuts, and the running counts of
set bits (rank) map every cut to the tokens of A and B that end there, hence to the token ranges
between two cuts (groups).  A link is a pair of token occurrences that end together; tokens have a
byte at least, so that every group ends in one link.

How often a pair of ids is linked is counted over the whole corpus.  Blocks store each document's
distinct pairs as codes into the block's list; a block asks once for each of its distinct pairs, so
that what is shuffled is a row for each pair and block and not for each link, and a pair that all
texts have is asked for once by each block.  Texts are encoded once, copies in a block once together.

Defined cases: null and empty texts, and texts whose bytes the tokens do not give back (the piece
tokenizer reads U+2581 as a space), have no tokens; special tokens' strings are plain text; very
long texts are a block of their own; ids may be of any type and may be null, repeated rows are
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import slices
from .shared import giving_back, materialise

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Below this code point, the two libraries for byte-level tokenizers are known to split texts alike (a test compares them on all these characters).
PLAIN = 0x250
_WORD = np.dtype("<u8")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable ones as themselves, the others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from its JSON file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        model = json.loads(open(path, encoding="utf-8").read())
        byte = _byte_of_letter()
        special = {t["id"] for t in model["added_tokens"] if t["special"]}
        self.entries = [b""] * self.whole.get_vocab_size()
        for entry, i in model["model"]["vocab"].items():
            self.entries[i] = entry.encode() if i in special else bytes(byte[c] for c in entry)
        ranks = {e: i for i, e in enumerate(self.entries) if i not in special}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        vocab = model["model"]["vocab"]
        # Ids in the order of the merges are ranks, which the faster library takes.
        ordered = all(vocab[a] < vocab[b] for a, b in zip(merges, merges[1:], strict=False))
        self.fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or max(map(ord, set(text))) < PLAIN):
            return np.array(self.fast.encode_ordinary(text), np.int32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """A SentencePiece model: ids of texts (which it puts a space before), and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.entries.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)


class _Table:
    """The bytes of a vocabulary's entries, one after another."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class _Numbers:
    """Decimal ids, each with a mark after it."""

    def __init__(self, most: int, marks: bytes):
        self.most = most
        text = [str(i).encode() + marks[k : k + 1] for k in range(len(marks)) for i in range(most)]
        self.size = np.array([len(t) for t in text], np.int64)
        self.width = int(self.size.max())
        self.table = np.frombuffer(b"".join(t.ljust(self.width) for t in text), np.uint8).reshape(-1, self.width)

    def written(self, ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and the size of each number."""
        row = mark * self.most + ids
        size = self.size[row]
        return self.table[row][np.arange(self.width) < size[:, None]], size


@functools.lru_cache(maxsize=2)
def _both(path_a: str, path_b: str) -> tuple:
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, _Table(a.entries), _Table(b.entries), _Numbers(max(len(a.entries), len(b.entries)), b",|;")


def _bitset(n: int, at: np.ndarray) -> np.ndarray:
    """A set of bits over n places, packed into words."""
    marked = np.zeros(-(-n // 64) * 64, np.uint8)
    marked[at] = 1
    return np.packbits(marked, bitorder="little").view(_WORD)


def _select(bits: np.ndarray) -> np.ndarray:
    """The places of the set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each place."""
    total = np.append(0, np.cumsum(np.bitwise_count(bits).astype(np.int64)))
    within = bits[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return total[at >> 6] + np.bitwise_count(within)


class Aligned:
    """Texts of a block: their tokens one after another, and the tokens of A and B that end at each shared cut."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        self.a, self.b, table_a, table_b, self.numbers = _both(path_a, path_b)
        self.known: dict[str, int] = {}
        self.of = np.array([self.known.setdefault(t, len(self.known)) if t else -1 for t in texts], np.int64)
        ids_a, ids_b, at = [], [], 0
        ends_a, ends_b, self.bytes = [], [], [0]
        for text in self.known:
            body = np.frombuffer(b" " + text.encode(), np.uint8)
            a, b = self.a.ids(" " + text), self.b.ids(text)
            if not (np.array_equal(table_a.joined(a), body) and np.array_equal(table_b.joined(b), body)):
                a = b = np.zeros(0, np.int32)
            ids_a.append(a)
            ids_b.append(b)
            if len(a):
                ends_a.append(np.cumsum(table_a.size[a]) + at - 1)
                ends_b.append(np.cumsum(table_b.size[b]) + at - 1)
                at += len(body)
            self.bytes.append(at)
        empty = [np.zeros(0, np.int64)]
        self.ids_a, self.ids_b = (np.concatenate(x).astype(np.int64) if x else empty[0] for x in (ids_a, ids_b))
        bits_a, bits_b = (_bitset(at, np.concatenate(x or empty)) for x in (ends_a, ends_b))
        self.cuts = _select(bits_a & bits_b)
        #: The token of A and the one of B that end at each cut.
        self.last_a, self.last_b = _rank(bits_a, self.cuts), _rank(bits_b, self.cuts)
        edges = np.array(self.bytes, np.int64)
        #: First group, token of A and token of B of each text.
        self.group = np.searchsorted(self.cuts, edges)
        self.first_a = np.append(0, np.cumsum([len(x) for x in ids_a], dtype=np.int64))
        self.first_b = np.append(0, np.cumsum([len(x) for x in ids_b], dtype=np.int64))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        group_a, group_b = (np.searchsorted(last, np.arange(n)) for last, n in ((self.last_a, n_a), (self.last_b, n_b)))
        # A's tokens of a group come after B's tokens of the groups before, and B's after A's of the group itself.
        before_b = np.append(0, self.last_b + 1)
        place_a = np.arange(n_a) + before_b[group_a]
        place_b = np.arange(n_b) + (self.last_a + 1)[group_b]
        ids, mark = np.zeros(n_a + n_b, np.int64), np.zeros(n_a + n_b, np.int64)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        mark[place_a[self.last_a]], mark[place_b[self.last_b]] = 1, 2
        data, size = self.numbers.written(ids, mark)
        end = np.append(0, np.cumsum(size))
        first = self.first_a + self.first_b
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[end[lo] : end[hi] - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(first, first[1:], strict=False)]

    def groups(self, k: int) -> list[dict]:
        """The groups of the k-th text: byte range (in space+text), ids of A and ids of B."""
        out = []
        if self.of[k] < 0:
            return out
        k = int(self.of[k])
        a, b, at = int(self.first_a[k]), int(self.first_b[k]), self.bytes[k]
        for g in range(self.group[k], self.group[k + 1]):
            ea, eb, cut = int(self.last_a[g]) + 1, int(self.last_b[g]) + 1, int(self.cuts[g]) + 1
            out.append({"start": at - self.bytes[k], "end": cut - self.bytes[k], "a": self.ids_a[a:ea].tolist(), "b": self.ids_b[b:eb].tolist()})
            a, b, at = ea, eb, cut
        return out


GROUPS_TYPE = "array<struct<start: bigint, end: bigint, a: array<bigint>, b: array<bigint>>>"


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the groups of every text: the token ranges between shared cuts, with their bytes."""

    @giving_back
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK // 8):
                found = Aligned(part.column(1).to_pylist(), path_a, path_b)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([found.groups(k) for k in range(part.num_rows)], kind)], names=["id", "groups"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(align, f"id {rows.schema['id'].dataType.simpleString()}, groups {GROUPS_TYPE}")


def _blocks(path_a: str, path_b: str):
    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                found = Aligned(part.column(1).to_pylist(), path_a, path_b)
                pair = found.ids_a[found.last_a] << 32 | found.ids_b[found.last_b]
                pairs, code = np.unique(pair, return_inverse=True)
                groups = np.diff(found.group)
                of_text = np.repeat(np.arange(len(groups)), groups)
                used, times = np.unique(of_text * max(1, len(pairs)) + code, return_counts=True)
                of, code = np.divmod(used, max(1, len(pairs)))
                copies = np.bincount(found.of[found.of >= 0], minlength=len(groups))
                total = np.bincount(code, times * copies[of], len(pairs)).astype(np.int64)
                row = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), row(found.of),
                        *[row(x) for x in (np.diff(found.first_a), np.diff(found.first_b), groups)], pa.array([found.digests()], pa.list_(pa.string())),
                        row(np.bincount(of, minlength=len(groups))), row(code), row(times), pa.array([pairs], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64())),
                    ],
                    names=["block", "ids", "of", "n_a", "n_b", "n_groups", "digest", "used", "code", "times", "pairs", "total"],
                )
                number += 1

    return encode


@giving_back
def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block, with the counts that it asked for."""
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda name: batch.column(batch.schema.get_field_index(name))[r]  # noqa: E731, B023
            ints = {n: np.frombuffer(get(n).as_py(), "<i4").astype(np.int64) for n in ("of", "n_a", "n_b", "n_groups", "used", "code", "times")}
            pairs = get("pairs").values.to_numpy()
            asked = get("asked").values
            if asked is None:
                asked = pa.array([], pa.struct([("pair", pa.int64()), ("n", pa.int64()), ("most", pa.int64())]))
            pair, n, most = (asked.field(k).to_numpy() for k in range(3))
            order = np.argsort(pair)[np.searchsorted(np.sort(pair), pairs)] if len(pairs) else np.zeros(0, np.int64)
            n, most = n[order], most[order]
            of = np.repeat(np.arange(len(ints["used"])), ints["used"])
            size = len(ints["used"])
            times, code = ints["times"], ints["code"]
            best = np.bincount(of, times * (n == most)[code], size).astype(np.int64)
            total = np.zeros(size, np.int64)
            np.add.at(total, of, times * n[code])
            text = ints["of"]
            none = text < 0
            show = lambda x: pa.array(np.where(none, 0, np.append(x, 0)[text]))  # noqa: E731, B023
            digest = [*get("digest").as_py(), ""]
            yield pa.RecordBatch.from_arrays(
                [get("ids").values, *[show(ints[c]) for c in ("n_a", "n_b", "n_groups", "n_groups")], show(best), show(total), pa.array([digest[t] for t in text.tolist()], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def linked_counts(blocks: DataFrame) -> DataFrame:
    """pair (A's id times 2^32 plus B's id), n (how many links hold it, over the corpus) and most (the largest n of its B id)."""
    asked = blocks.select(F.explode(F.arrays_zip("pairs", "total")).alias("x"))
    counts = asked.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.total").alias("n"))
    counts = materialise(counts.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)))
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", "most")


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token, group and link counts and the digest of the groups of every document; see the module's docstring."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    ints = [T.StructField(n, T.BinaryType()) for n in ("n_a", "n_b", "n_groups")]
    fields = [
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("of", T.BinaryType()), *ints, T.StructField("digest", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.BinaryType()) for n in ("used", "code", "times")], *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "total")],
    ]
    blocks = materialise(rows.mapInArrow(_blocks(path_a, path_b), T.StructType(fields)))
    asked = blocks.select("block", F.explode("pairs").alias("pair")).join(linked_counts(blocks), "pair")
    replies = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "most")).alias("asked"))
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    out = T.StructType([T.StructField("doc_id", kind), *longs, T.StructField("groups_sha256", T.StringType())])
    return blocks.join(replies, "block", "left").drop("total").mapInArrow(_scored, out)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
