"""Removal of repeated byte strings, with suffixes sorted in two stages.

Every start of a string of WIDTH bytes belongs to a run: neighbouring starts whose
strings have the same least k-gram (by hash; the first of equal ones), the run's anchor.
Equal strings have equal anchors, so:

1. Each task sends anchor and context (the bytes that the run's strings cover, hashed) of
   its runs, equal ones once.  Where the anchor is alone in the corpus, no string of the
   run repeats; where the context is met twice, all do.  Anchors that many documents have
   (found on a sample, on which nothing else depends) are dealt over groups by context.
2. Only for the rest (about a twenty-fifth of the runs of the test tables) do bytes
   travel: the contexts of an anchor meet in one group, are laid one after another, and
   their suffixes are sorted in two stages: suffixes smaller than their successors
   directly, all others by scans over the buckets of first bytes.  Neighbours in that
   order with a common prefix of WIDTH bytes are repeats.  With ``everything``, this is done for
   every string whose anchor is met twice, and hashes decide nothing but that an anchor is alone.
3. An anchor with more than SPLIT contexts is dealt over blocks; each block is sorted as
   above, and classes of equal strings of different blocks meet by hash.
4. A document is cut once, by the union of what its runs lose.

64-bit hashes of contexts (besides at least 41 bits of the anchor) stand for their bytes, 96 bits of two
hashes of id and text for a row.

Defined cases: a null text is empty; texts under WIDTH bytes lose nothing; equal rows
(same id and text) repeat each other and get equal results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .exchange import dealt, grouped, slices
from .shared import giving_back, group_count, materialise

WIDTH = 200
GRAM = 100
SPLIT = 256
#: Bytes whose runs are found at a time.
PIECE = 1 << 20
#: Groups an exchange partition takes.
GROUPS = 16
PLACE_BITS = 27
#: Documents on which hot anchors are counted, about, and their share of all at most; records of an anchor there that make it hot.
HOT_ROWS, HOT_SHARE, HOT_SEEN = 100_000, 0.02, 16

RUN = np.dtype([("anchor", "<u4"), ("context", "<u8"), ("key", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("n", "<u2")])
REPLY = np.dtype([("key", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("n", "<u2"), ("what", "u1"), ("blocks", "<u4"), ("anchor", "<u8")])
NEED = np.dtype([("start", "<i4"), ("n", "<u2"), ("what", "u1"), ("blocks", "<u4"), ("anchor", "<u8")])
CLASS = np.dtype([("string", "<u8"), ("key", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("lone", "u1")])
TWICE = 1 << 15  # in n: the task has met the context twice
REPEATED, BYTES = 1, 2  # in what


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of so many values."""
    m = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start in the row, number of strings, anchor hash and context hash of each run, piece by piece."""
    up, down = bw._grow(PIECE + width + 1)
    for lo in range(0, max(0, len(data) - width + 1), PIECE):
        part = data[lo : lo + PIECE + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        grams = bw.mix((total[gram:] - total[: len(part) - gram + 1]) * down[: len(part) - gram + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = _least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        anchor = (least & low).astype(np.int64)
        n = len(anchor)
        row = np.searchsorted(offsets, np.arange(lo, lo + n), side="right") - 1
        left = offsets[row + 1] - lo - np.arange(n)  # bytes to the end of the row
        first = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) & (left >= width)
        start = np.flatnonzero(first)
        count = np.minimum(np.append(start[1:], n) - start, left[start] - width + 1)
        context = bw.mix((total[start + count - 1 + width] - total[start]) * down[start] + (anchor[start] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        yield row[start], start + lo - offsets[row[start]], count, grams[anchor[start]], context


def _send_runs(groups: int, targets: int, width: int, gram: int, hot: np.ndarray, salts: np.ndarray, everything: bool):
    """Runs of the documents, dealt by anchor, those of the hot anchors by anchor and context; repeats within the task's batch go straight to their document's target."""
    base = groups + np.cumsum(salts) - salts  # first group of each hot anchor

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 16 << 20):
                data, offsets = bw.raw_bytes(part.column(2))
                keys, tags = part.column(0).to_numpy(), part.column(1).to_numpy()
                found = [np.concatenate(x) for x in zip(*runs(data, offsets, width, gram), strict=True)]
                if not found or not len(found[0]):
                    continue
                row, start, count, anchor, context = found
                record = np.zeros(len(row), RUN)
                record["anchor"], record["context"], record["key"], record["start"], record["n"] = anchor & np.uint64(0xFFFFFFFF), context, keys[row], start, count
                record["tag"] = tags[row]
                order = np.lexsort((context, anchor))
                a, c = anchor[order], context[order]
                first = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | everything)
                spot = np.flatnonzero(first)
                many = np.diff(np.append(spot, len(order))) > 1
                record["n"][order[spot[many]]] |= TWICE
                again = order[~first]
                sent = order[spot]
                to = ((anchor[sent] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                if len(hot):
                    h = np.minimum(np.searchsorted(hot, anchor[sent]), len(hot) - 1)
                    is_hot = hot[h] == anchor[sent]
                    to = np.where(is_hot, base[h] + (context[sent] % salts[h].astype(np.uint64)).astype(np.int64), to)
                rows = list(dealt(to, record[sent]))
                reply = np.zeros(len(again), REPLY)
                for field in ("key", "tag", "start", "n"):
                    reply[field] = record[field][again]
                reply["what"] = REPEATED
                rows += [(-1 - t, x) for t, x in dealt(reply["key"] % targets, reply)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["grp", "data"])

    return send


def _resolve(groups: int, targets: int, split: int, salts: np.ndarray, everything: bool):
    """What each run of one group of anchors is: repeated, in need of bytes, or neither (no reply).

    With everything, each run whose anchor occurs twice is in need of bytes, and none is known to be repeated.
    """
    base = groups + np.cumsum(salts) - salts

    @giving_back
    def resolve(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        blob = b"".join(table.column("data").to_pylist())
        if group < 0:
            return pa.table({"target": pa.array([-1 - group], pa.int32()), "data": pa.array([blob], pa.binary())})
        r = np.frombuffer(blob, RUN)
        order = np.lexsort((r["start"], r["tag"], r["key"], r["context"], r["anchor"]))
        r = r[order]
        new_anchor = np.append(True, r["anchor"][1:] != r["anchor"][:-1])
        new_context = new_anchor | np.append(True, r["context"][1:] != r["context"][:-1])
        context = np.cumsum(new_context) - 1
        anchor = np.cumsum(new_anchor) - 1
        home, spread = group, 0
        repeated = ((np.bincount(context) > 1) | (np.bincount(context, r["n"] >= TWICE) > 0))[context]
        kinds = np.bincount(anchor, new_context).astype(np.int64)[anchor]  # different contexts of the anchor
        lone = np.bincount(anchor, ~repeated)[anchor] > 0  # some context of it is met once
        needed = new_context & (kinds > 1) & lone
        if everything:
            kinds = np.bincount(anchor)[anchor]
            repeated, needed = np.zeros(len(r), bool), kinds > 1
        if group >= groups:
            # One salt of a hot anchor: what the other salts have is not seen here, so every context sends its bytes.
            k = int(np.searchsorted(base, group, side="right")) - 1
            home, spread = groups + k, int(salts[k])
            needed = np.ones(len(r), bool) if everything else new_context
            kinds = kinds * spread
        keep = repeated | needed
        reply = np.zeros(int(keep.sum()), REPLY)
        for field in ("key", "tag", "start"):
            reply[field] = r[field][keep]
        reply["n"] = r["n"][keep] & (TWICE - 1)
        reply["what"] = repeated[keep] * REPEATED + needed[keep] * BYTES
        reply["blocks"] = np.where(needed[keep], np.maximum(-(-kinds[keep] // split), 1 + (spread > 0)), 0)
        reply["anchor"] = np.where(needed[keep], (np.uint64(home) << np.uint64(32)) | r["anchor"][keep].astype(np.uint64), np.uint64(0))
        rows = list(dealt(reply["key"] % targets, reply))
        return pa.table({"target": pa.array([t for t, _ in rows], pa.int32()), "data": pa.array([x for _, x in rows], pa.binary())})

    return resolve


def _rows_of(key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each (key, tag), and the key and tag of each number."""
    both = np.zeros(len(key), [("key", "<i8"), ("tag", "<i4")])
    both["key"], both["tag"] = key, tag
    known, number = np.unique(both, return_inverse=True)
    return number.ravel().astype(np.int64), known["key"], known["tag"]


#: A stretch of a document.
CUTS = "key long, tag int, lo long, hi long"


def _per_document(width: int):
    """Of one target's replies: each document's repeated stretches (lo, hi), or its runs in need of bytes (need)."""

    @giving_back
    def gather(table: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(table.column("data").to_pylist()), REPLY)
        number, keys, tags = _rows_of(r["key"], r["tag"])
        at = np.flatnonzero((r["what"] & REPEATED) > 0)
        d = r[at]
        lo, hi, own = _united(number[at], d["start"].astype(np.int64), d["start"].astype(np.int64) + d["n"] + width - 1)
        at = np.flatnonzero((r["what"] & BYTES) > 0)
        need = np.zeros(len(at), NEED)
        for field in NEED.names:
            need[field] = r[field][at]
        order, first, ends = grouped(number[at])
        blobs = [need[order[x:y]].tobytes() for x, y in zip(first, ends, strict=True)]
        own = np.concatenate([own, number[at][order[first]]])
        n, m = len(lo), len(blobs)
        return pa.table({
            "key": pa.array(keys[own], pa.int64()), "tag": pa.array(tags[own], pa.int32()),
            "lo": pa.concat_arrays([pa.array(lo, pa.int64()), pa.nulls(m, pa.int64())]),
            "hi": pa.concat_arrays([pa.array(hi, pa.int64()), pa.nulls(m, pa.int64())]),
            "need": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())]),
        })

    return gather


def _united(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of each key from stretches that may overlap or touch."""
    if not len(key):
        return lo, hi, key
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    # Running ends within a key: keys are numbered and spread so far that they cannot mix.
    number = np.cumsum(np.append(0, key[1:] != key[:-1]))
    far = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + number * far) - number * far
    new = np.append(True, (key[1:] != key[:-1]) | (lo[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return lo[first], reach[np.append(first[1:], len(lo)) - 1], key[first]


def _send_contexts(groups: int, width: int):
    """The bytes of the runs in need, each with the group it is sorted in."""

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 16 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for key, tag, text, need in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    raw = memoryview(text.as_buffer())
                    r = np.frombuffer(need.as_py(), NEED)
                    start, n = r["start"].astype(np.int64), r["n"].astype(np.int64)
                    blocks = np.maximum(r["blocks"].astype(np.uint64), np.uint64(1))
                    salt = bw.mix(np.uint64(key % (1 << 64)) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % blocks
                    group = bw.mix(r["anchor"] * np.uint64(0xD6E8FEB86659FD93) + salt) % np.uint64(groups)
                    out[0] += group.tolist()
                    out[1] += [key] * len(r)
                    out[2] += start.tolist()
                    out[3] += (blocks > 1).tolist()
                    out[4] += [bytes(raw[a : a + b + width - 1]) for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                    out[5] += [tag] * len(r)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32()), strict=True)], names=["grp", "key", "start", "split", "context", "tag"])

    return send


def sorted_starts(text: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """The wanted suffixes of several contexts in order of their first ``width`` bytes.

    text: bytes raised by one, each context followed by a zero; first, last: places of the
    first and last wanted suffix of each context.
    """
    n = len(text)
    step = np.sign(text[:-1].astype(np.int16) - text[1:].astype(np.int16))
    settled = np.where(step != 0, np.arange(n - 1), n - 1)
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    larger = np.append(step, 0)[np.minimum(settled, n - 1)] > 0  # larger than its successor
    larger = np.append(larger, False)
    direct = ~larger & (text > 0)
    # From each place on, the next suffix to be sorted directly, or the end of its context.
    stop = np.where(direct | (text == 0), np.arange(n), n - 1)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, stop[last] + 1, -1)
    wanted = np.cumsum(change[:-1]) > 0
    # Stage one: suffixes smaller than their successors.
    place = np.flatnonzero(wanted & direct)
    end = np.minimum.accumulate(np.where(text == 0, np.arange(n), n - 1)[::-1])[::-1]
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[place]
    keys[np.arange(width) >= (end[place] - place)[:, None]] = 0
    place = place[np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel())]
    head = text[place]
    # Stage two: each suffix in order gives its predecessor a place in the bucket of the predecessor's byte.
    waiting: dict[int, list[np.ndarray]] = {}

    def give(order: np.ndarray, least: int) -> None:
        before = order - 1
        before = before[before >= 0]
        before = before[wanted[before] & larger[before] & (text[before] > least)]
        if not len(before):
            return
        to = text[before]
        by = np.argsort(to, kind="stable")
        values, starts = np.unique(to[by], return_index=True)
        for value, part in zip(values.tolist(), np.split(before[by], starts[1:]), strict=True):
            waiting.setdefault(value, []).append(part)

    give(np.flatnonzero(text == 0), 0)
    out = []
    for c in np.unique(text[wanted]).tolist():
        if c == 0:
            continue
        own = []
        wave = np.concatenate(waiting.pop(c, [np.zeros(0, np.int64)]))
        while len(wave):
            own.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[wanted[wave] & larger[wave] & (text[wave] == c)]
        a, b = np.searchsorted(head, (c, c + 1))
        own = np.concatenate([*own, place[a:b]])
        out.append(own)
        give(own, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeats(contexts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string start of the contexts, in suffix order: its context, its place in it, and the class of equal strings."""
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(size + 1) - (size + 1)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).copy()
    end = base + size
    text += 1
    text[end] = 0
    order = sorted_starts(text, base, end - width, width)
    context = np.searchsorted(base, order, side="right") - 1
    real = order <= end[context] - width
    order, context = order[real], context[real]
    same = np.zeros(len(order), bool)
    rows = np.lib.stride_tricks.sliding_window_view(text, width)
    for lo in range(1, len(order), 20_000):
        hi = min(len(order), lo + 20_000)
        r = rows[order[lo - 1 : hi]]
        same[lo:hi] = (r[1:] == r[:-1]).all(axis=1)  # common prefix with the suffix before: all of width
    return context, order - base[context], np.cumsum(~same) - 1


def _sort_group(targets: int, width: int):
    @giving_back
    def sort(table: pa.Table) -> pa.Table:
        key, keys, tags = _rows_of(table.column("key").to_numpy(), table.column("tag").to_numpy())
        start = table.column("start").to_numpy().astype(np.int64)
        split = table.column("split").to_numpy(zero_copy_only=False)
        contexts = table.column("context").to_pylist()
        context, place, kind = repeats(contexts, width)
        many = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, bool)
        lo, hi, own = _united(key[context[many]], start[context[many]] + place[many], start[context[many]] + place[many] + width)
        n = len(lo)
        # Strings of anchors dealt over blocks: one record a class, to meet its like of other blocks.  Only a string
        # alone in its block still has something to learn there.
        s = np.flatnonzero(split[context])
        s = s[np.append(True, kind[s][1:] != kind[s][:-1])[: len(s)]]
        record = np.zeros(len(s), CLASS)
        record["string"] = [int.from_bytes(hashlib.blake2b(contexts[context[i]][place[i] : place[i] + width], digest_size=8).digest(), "little") for i in s]
        record["key"], record["tag"] = keys[key[context[s]]], tags[key[context[s]]]
        record["start"], record["lone"] = start[context[s]] + place[s], ~many[s]
        rows = list(dealt((record["string"] % np.uint64(targets)).astype(np.int64), record))
        m = len(rows)
        return pa.table({
            "key": pa.concat_arrays([pa.array(keys[own], pa.int64()), pa.nulls(m, pa.int64())]),
            "tag": pa.concat_arrays([pa.array(tags[own], pa.int32()), pa.nulls(m, pa.int32())]),
            "lo": pa.concat_arrays([pa.array(lo, pa.int64()), pa.nulls(m, pa.int64())]),
            "hi": pa.concat_arrays([pa.array(hi, pa.int64()), pa.nulls(m, pa.int64())]),
            "target": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array([t for t, _ in rows], pa.int32())]),
            "data": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x for _, x in rows], pa.binary())]),
        })

    return sort


def _meet(width: int):
    """Strings alone in their block that another block has too."""

    @giving_back
    def meet(table: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(table.column("data").to_pylist()), CLASS)
        _, number, many = np.unique(r["string"], return_inverse=True, return_counts=True)
        r = r[(many[number] > 1) & (r["lone"] > 0)]
        row, keys, tags = _rows_of(r["key"], r["tag"])
        lo, hi, own = _united(row, r["start"].astype(np.int64), r["start"].astype(np.int64) + width)
        return pa.table({"key": pa.array(keys[own], pa.int64()), "tag": pa.array(tags[own], pa.int32()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    return meet


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with the two hashes, 96 bits, that know a row by its id and text."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.xxhash64(F.col(doc_id), body).alias("key"), F.hash(body, F.col(doc_id), F.lit("row")).alias("tag"), F.col(doc_id).alias("doc_id"), body.alias("body"))


def hot_anchors(keyed: DataFrame, groups: int, width: int, gram: int, rows: int = HOT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that more records have than a group should hold, sorted, and over how many groups each is dealt.

    Counted on about so many documents, an equal share of the hash range; only where records go depends on it.
    """
    share = min(HOT_SHARE, rows / max(1, keyed.count()))

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 16 << 20):
                for _, _, _, anchor, _ in runs(*bw.raw_bytes(part.column(0)), width, gram):
                    known, n = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    some = keyed.filter(F.pmod("tag", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("body").mapInArrow(count, "anchor long, n long")
    counted = some.groupBy("anchor").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # More than a fourth of a group's share of all records, and enough of them to tell: at most 4 x groups anchors.
    found = counted.filter(F.col("n") > max(HOT_SEEN, total // (4 * groups))).collect()
    found.sort(key=lambda r: r["anchor"] % (1 << 64))
    anchors = np.array([r["anchor"] for r in found], np.int64).view(np.uint64)
    return anchors, np.array([max(2, -(-4 * groups * r["n"] // max(1, total))) for r in found], np.int64)


def removed_stretches(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM, split: int = SPLIT, everything: bool = False) -> DataFrame:
    """key, tag and ``cuts``, the byte stretches to remove, for documents (key, tag, body) that lose any; stretches may overlap."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = group_count(keyed, "body", n)
    groups = n * GROUPS
    hot, salts = hot_anchors(keyed, groups, width, gram)
    sent = keyed.select("key", "tag", "body").mapInArrow(_send_runs(groups, groups, width, gram, hot, salts, everything), "grp int, data binary")
    replies = sent.groupBy("grp").applyInArrow(_resolve(groups, groups, split, salts, everything), "target int, data binary")
    known = materialise(replies.groupBy("target").applyInArrow(_per_document(width), f"{CUTS}, need binary"))
    need = known.filter(F.col("need").isNotNull()).select("key", "tag", "need")
    # Equal rows have one key and only repeated runs, so a key in need has one row (with everything, each of them asks for all).
    bodies = keyed.select("key", "tag", "body").join(need, ["key", "tag"])
    contexts = bodies.select("key", "tag", "body", "need").mapInArrow(_send_contexts(groups, width), "grp int, key long, start int, split boolean, context binary, tag int")
    found = materialise(contexts.groupBy("grp").applyInArrow(_sort_group(n, width), f"{CUTS}, target int, data binary"))
    across = found.filter(F.col("target").isNotNull()).select("target", "data").groupBy("target").applyInArrow(_meet(width), CUTS)
    stretch = ["key", "tag", "lo", "hi"]
    cuts = known.filter(F.col("lo").isNotNull()).select(*stretch).union(found.filter(F.col("target").isNull()).select(*stretch)).union(across.select(*stretch))
    return cuts.groupBy("key", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))


def _cut(kind: str, keep_text: bool):
    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, cuts in zip(batch.column(1), batch.column(2), strict=True):
                raw = memoryview(body.as_buffer()) if len(body.as_buffer()) else memoryview(b"")
                lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if cuts.is_valid:
                    flat = cuts.values
                    a, b = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    lo, hi, _ = _united(np.zeros(len(a), np.int64), a, b)
                kept, seen = [], 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    kept.append(raw[seen:a])
                    seen = b
                kept.append(raw[seen:])
                digest = hashlib.sha256()
                for x in kept:
                    digest.update(x)
                rows.append((len(raw), int((hi - lo).sum()), len(lo), digest.hexdigest(), b"".join(kept) if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 4 + keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return cut


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int | None = None, split: int = SPLIT, keep_text: bool = False, everything: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept; with everything, hashes only leave out strings whose anchor occurs once."""
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = _keyed(docs, doc_id, text)
    both = keyed.join(removed_stretches(keyed, width, gram or width // 2, split, everything), ["key", "tag"], "left").select("doc_id", "body", "cuts")
    return both.mapInArrow(_cut(kind, keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
