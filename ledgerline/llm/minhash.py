"""Near-duplicate components with b-bit MinHash.

A document is the set of its k-word shingles.  ``HASHES`` hash functions give a minimum each; the
low ``BITS`` bits of every minimum are packed into a signature, one bit plane after another, and
``ROWS`` whole minima at a time make a band.

* Equal sets are one class, so copies cost nothing after the first step.
* Classes that share a band's value are candidates.  First each class is paired with the first
  class of every band it shares, a number of pairs linear in the classes; this joins the copies of
  one text whatever their number.
* Then bands that hold classes of different components are compared inside: in tiles of bounded
  size, pairs of different components whose sizes allow it.  Only candidates whose similarity,
  estimated by counting equal places in the packed signatures and corrected for the places that
  agree by chance (one in 2^BITS), comes near the threshold leave the tile; of these again only
  those whose parities (2,048 bits that each shingle flips one of) allow a link: the bits in
  which two sets differ are never more than the shingles in which they do.
* Every candidate is confirmed on the whole sets.

A pair at the threshold of 0.8 is missed by all 38 bands of 5 rows with a chance of 3e-7, and
falls below the estimate's margin (``MARGIN``, six standard deviations) with less than 1e-7; a
component loses a document only if all its links are missed.  Nothing else is left out: no bucket
is capped.

Defined cases: those of ``set_join``: empty sets are linked with nothing, texts of fewer than k
words have one shingle, ids may be null or of any type with an order, equal rows share a component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from . import set_join as sj
from .exchange import slices
from .shared import giving_back, materialise
from .sketches import parities, parted
from .tiles import TILE, compared

PERCENT, WORDS = 80, 4
HASHES, ROWS, BITS = 192, 5, 4
BANDS = HASHES // ROWS
#: Estimates this far below the threshold are still confirmed.
MARGIN = 0.22
#: Shingles hashed at a time.
CHUNK = 1 << 14


@functools.lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of the hash functions, from a fixed rule."""
    drawn = bw.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[HASHES:] >> np.uint64(32)).astype(np.uint32)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set of 64-bit shingle hashes."""
    times, plus = _functions()
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(tokens), CHUNK):
        part = tokens[lo : lo + CHUNK]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        made = low[None, :] * times[:, None]
        made += plus[:, None]
        made ^= high[None, :]
        made *= times[::-1, None]
        np.minimum(out, made.min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima: BITS planes of HASHES bits, in words of 64."""
    # The low bits of a minimum are those of a small number; mixed, they are as good as random.
    low = bw.mix(least.astype(np.uint64))
    planes = np.stack([(low >> np.uint64(k)) & np.uint64(1) for k in range(BITS)], axis=-2).astype(np.uint8)
    return np.packbits(planes, axis=-1, bitorder="little").view("<u8").reshape(*least.shape[:-1], -1)


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of minima; those of different bands differ."""
    rows = least[..., : BANDS * ROWS].reshape(*least.shape[:-1], BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    for r in range(ROWS):
        value = bw.mix(value ^ rows[..., r]) * np.uint64(0x9E3779B97F4A7C15)
    return bw.mix(value)


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: the share of equal places, without what agrees by chance."""
    words = HASHES // 64
    differ = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1], np.int64)
    for w in range(words):
        unlike = np.uint64(0)
        for k in range(BITS):
            unlike = unlike | (x[..., k * words + w] ^ y[..., k * words + w])
        differ += np.bitwise_count(unlike)
    chance = 0.5**BITS
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def _described(k: int):
    """Each row's set size, identity, signature, parities and bands."""

    @giving_back
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, sj.SLICE):
                token, offsets = sj._sets(part.column(2), k)
                n = np.diff(offsets)
                names = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.append(np.uint64(0), np.cumsum(bw.mix(token + np.uint64(salt))))
                    names.append(bw.mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                # Copies in the batch have their minima taken once.
                _, first, copy = np.unique(np.stack(names, axis=1), axis=0, return_index=True, return_inverse=True)
                least = np.stack([minima(token[offsets[i] : offsets[i + 1]]) for i in first]) if len(first) else np.zeros((0, HASHES), np.uint32)
                packed, values = (np.ascontiguousarray(f(least))[copy.ravel()] for f in (signature, bands))
                odd = parities(token, offsets)
                blob = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int32)), *map(pa.array, names), blob(packed), blob(odd), pa.FixedSizeListArray.from_arrays(pa.array(values.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))],
                    names=["key", "tag", "n", "a", "b", "packed", "odd", "bands"],
                )

    return describe


def _inside(entries: DataFrame, classes: DataFrame, label: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Candidates of different components that share a band's value, by size, estimate and parities."""
    marked = entries.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_ = marked.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    held = materialise(marked.join(open_, "band").join(classes.select(F.col("number").alias("key"), "n", "packed", "odd"), "key"))

    def test(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = estimated(c["packed"][x], c["packed"][y]) >= percent / 100 - MARGIN
        near[near] = ~parted(c["odd"][x[near]], c["odd"][y[near]], c["n"][x[near]], c["n"][y[near]], percent)
        return near.astype(np.int64)

    return compared(held, ["band"], "n", lambda c: c["n"].astype(np.int64) * 100 // percent, test, tile).select("x", "y")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """key, tag, doc (the id as given), n_shingles, component and label of every row, as in set_join."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key, tag = sj._keyed(doc_id, text)
    keyed = docs.select(key.alias("key"), tag.alias("tag"), body.alias("body"))
    rows = materialise(keyed.mapInArrow(_described(k), "key long, tag int, n int, a long, b long, packed binary, odd binary, bands array<long>"))
    one = F.min(F.struct("key", "tag")).alias("first")
    classes = rows.filter("n > 0").groupBy("a", "b", "n").agg(one).select("a", "b", "n", "first.key", "first.tag")
    known = rows.dropDuplicates(["key", "tag"]).select("key", "tag", "packed", "odd", "bands")
    classes = materialise(classes.join(known, ["key", "tag"]).withColumn("number", F.monotonically_increasing_id()))

    entries = classes.select(F.col("number").alias("key"), F.explode("bands").alias("band"))
    heads = entries.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("last")).filter("head < last").select("band", "head")
    entries = materialise(entries.join(heads, "band"))
    told = classes.select("number", "n", "packed", "odd")
    pairs = entries.filter("head < key").select(F.col("head").alias("x"), F.col("key").alias("y")).distinct()
    signs = pairs.join(told.toDF("x", "nx", "px", "ox"), "x").join(told.toDF("y", "ny", "py", "oy"), "y").filter(f"least(nx, ny) * 100 >= greatest(nx, ny) * {percent}")
    near = signs.mapInArrow(_estimated(percent), "x long, y long")
    # Only texts that meet another one are read again.
    met = entries.select(F.col("key").alias("number")).distinct()
    bodies = keyed.join(classes.join(met, "number").select("key", "tag", "number"), ["key", "tag"]).select(F.col("number").alias("key"), "body")
    bodies = materialise(bodies.dropDuplicates(["key"]))
    links = materialise(sj._verified(near, bodies, percent, k))
    label = sj.components(links)
    more = sj._verified(_inside(entries.select("key", "band"), classes, label, percent), bodies, percent, k)
    return sj.of_rows(docs, doc_id, text, rows, classes, sj.components(links.union(more)))


def _estimated(percent: int):
    @giving_back
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            x, y, ox, oy = (np.frombuffer(b"".join(of(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("px", "py", "ox", "oy"))
            near = (estimated(x, y) >= percent / 100 - MARGIN) & ~parted(ox, oy, of("nx").to_numpy(), of("ny").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("x", "y")], names=["x", "y"]).filter(pa.array(near))

    return keep


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    doc = F.col("doc")
    return found.select(doc.alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), doc.eqNullSafe(F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
r(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.met = l.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.met) AS component_id, min(r.met) = d.doc_id AS kept
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
