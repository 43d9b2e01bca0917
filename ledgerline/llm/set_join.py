"""Exact set similarity join on word shingles with set-relation skipping.

A document is the set of its k-word shingles (64-bit hashes).  Links join documents whose
Jaccard similarity reaches ``percent``; the result is the component of each document.

* Equal sets are one class; a class is joined once, whatever the number of its copies.
* A set of n shingles can miss m = n - ceil(percent n / 100) of them in a partner, so by
  their order two partners share l of their first m + l shingles.  Every set sends its
  first 2 m + 1; a set with too few shingles there that any other set has cannot have a
  partner.  Most sets end here, and their texts are not read again.
* The rest is indexed: the first m + 1 shingles of each, the widely used ones last.  Index
  lists are cut by size band; sets of other bands are skipped.
* Most lists are short, since their shingle is in a few texts by chance: their entries are sent once
  and compared where they meet, unless many of them are near each other.
* In the other lists every set is compared with at most four leaders (least and greatest by key
  and by size), which joins the copies of one text in a step linear in their number.  What each
  set has in common with its most similar leader is kept as its answer.
* Then those of them that hold sets of different components are searched, in tiles of bounded size and
  in the order of the shingle's place in the sets: blocks of places that leave too few common
  shingles on either side are skipped.  A pair with one leader is derived from its answers: they
  bound what the two have in common from above, which ends some, and from below, which links some
  unseen.  Parities (each shingle flips one bit; first 256 bits, then two bits a shingle) end
  nearly all others.  Of a set, a task gives few pairs; where one has more, what is found so far is
  linked first, and what is then still between different components is searched again.

Every remaining candidate pair is verified on the whole sets.  Rows are known by 96 bits of two
hashes of id and text, sets by 128 bits and their size, and classes by numbers given to them.

Defined cases: null texts and texts without words have an empty set and are linked with
nothing; texts with fewer than k words have one shingle, their whole sequence; equal rows
have one component; ids may be of any type that has an order, null ids are larger than all others,
and a component of null ids alone has a null id; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .exchange import dealt, slices
from .shared import giving_back, group_count, materialise
from .sketches import Wide, wide_parities
from .tiles import BROADCAST_GROUPS, SMALL, TILE, compared, settled

PERCENT, WORDS = 90, 3
GROUPS = 4
#: Slots of the usage counts that order shingles: 2 to this power, in every task and on the driver.
USAGE_BITS = 22
#: Bytes of text whose words are in memory at a time.
SLICE = 4 << 20
#: Links that one task turns into stars, about.
TASK_LINKS = 1_000_000
#: Pairs of a set that one task gives in the first search, and how many times as many in each further one.
MOST, MORE = 16, 16

TOKEN = np.dtype([("token", "<u4"), ("key", "<i8"), ("known", "u1")])
COUNT = np.dtype([("key", "<i8"), ("shared", "<i4")])
INFO = np.dtype([("key", "<i8"), ("tag", "<i4"), ("n", "<i4"), ("a", "<u8"), ("b", "<u8"), ("shared", "<i4")])


def _misses(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = bw.raw_bytes(column)
    row, _, _, hashes = bw.words(data, offsets, lower=True)
    n = len(offsets) - 1
    return bw.distinct_sets(*bw.shingles(row, hashes, n, k), n)


def _send_first(groups: int, targets: int, percent: int, k: int):
    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                token, offsets = _sets(part.column(2), k)
                key, tag = part.column(0).to_numpy(), part.column(1).to_numpy()
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(token)) - offsets[row]
                info = np.zeros(len(n), INFO)
                info["key"], info["tag"], info["n"] = key, tag, n
                info["a"] = np.bincount(row, minlength=len(n)).astype(np.uint64)
                for field, salt in (("a", 0x9E3779B97F4A7C15), ("b", 0xC2B2AE3D27D4EB4F)):
                    total = np.append(np.uint64(0), np.cumsum(bw.mix(token + np.uint64(salt))))
                    info[field] = bw.mix(total[offsets[1:]] - total[offsets[:-1]])
                # Copies in the batch send their shingles once; a shingle met twice in the batch needs no reply.
                _, first, copy = np.unique(np.stack([info["a"], info["b"]], axis=1), axis=0, return_index=True, return_inverse=True)
                copies = np.bincount(copy.ravel())[copy.ravel()]
                own = np.zeros(len(n), bool)
                own[first] = True
                front = place < (2 * _misses(n, percent) + 1)[row]
                sent = np.flatnonzero(front & own[row])
                mixed = bw.mix(token[sent] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                order = np.argsort(mixed, kind="stable")
                m, r = mixed[order], row[sent][order]
                new = np.append(True, m[1:] != m[:-1])[: len(m)]
                spot = np.flatnonzero(new)
                alone = (np.diff(np.append(spot, len(m))) == 1) & (copies[r[spot]] == 1)
                record = np.zeros(len(spot), TOKEN)
                record["token"], record["key"], record["known"] = m[spot] & np.uint64(0xFFFFFFFF), key[r[spot]], ~alone
                known = np.ones(len(m), bool)
                known[spot[alone]] = False
                shared = np.bincount(r[known], minlength=len(n))
                info["shared"] = np.where(copies > 1, n, shared)
                rows = list(dealt(((m[spot] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64), record))
                rows += [(-1 - t, x) for t, x in dealt(key % targets, info)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["grp", "data"])

    return send


def _count_shared(targets: int):
    @giving_back
    def count(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        blob = b"".join(table.column("data").to_pylist())
        if group < 0:
            return pa.table({"target": pa.array([-1 - group], pa.int32()), "info": pa.array([True]), "data": pa.array([blob], pa.binary())})
        r = np.frombuffer(blob, TOKEN)
        _, number, many = np.unique(r["token"], return_inverse=True, return_counts=True)
        keys, shared = np.unique(r["key"][(many[number] > 1) & (r["known"] == 0)], return_counts=True)
        reply = np.zeros(len(keys), COUNT)
        reply["key"], reply["shared"] = keys, shared
        rows = list(dealt(keys % targets, reply))
        return pa.table({"target": pa.array([t for t, _ in rows], pa.int32()), "info": pa.array([False] * len(rows), pa.bool_()), "data": pa.array([x for _, x in rows], pa.binary())})

    return count


def _per_document(percent: int):
    @giving_back
    def gather(table: pa.Table) -> pa.Table:
        is_info = table.column("info").to_numpy(zero_copy_only=False)
        blobs = table.column("data").to_pylist()
        info = np.frombuffer(b"".join(x for x, i in zip(blobs, is_info, strict=True) if i), INFO)
        more = np.frombuffer(b"".join(x for x, i in zip(blobs, is_info, strict=True) if not i), COUNT)
        keys, number = np.unique(np.concatenate([info["key"], more["key"]]), return_inverse=True)
        total = np.bincount(number[len(info) :], more["shared"], len(keys))[number[: len(info)]] + info["shared"]
        n = info["n"].astype(np.int64)
        least = _misses((n * percent + 99) // 100, percent) + 1  # the fewest that a smallest partner would share
        return pa.table({
            "key": pa.array(info["key"]), "tag": pa.array(info["tag"]), "n": pa.array(info["n"]),
            "a": pa.array(info["a"].view(np.int64) if info["a"].flags.c_contiguous else info["a"].copy().view(np.int64)), "b": pa.array(info["b"].copy().view(np.int64)),
            "alive": pa.array((n > 0) & (total >= least)),
        })

    return gather


def _usage(bodies: DataFrame, k: int) -> np.ndarray:
    """How often each slot's shingles are used: one table of fixed size."""
    chunk = 1 << (USAGE_BITS - 4)
    most = np.iinfo(np.uint8).max  # of a task's counts: what is used more often is as good as this

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << USAGE_BITS, np.int32)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                token, _ = _sets(part.column(0), k)
                slot, n = np.unique(token >> np.uint64(64 - USAGE_BITS), return_counts=True)
                total[slot.astype(np.int64)] += n.astype(np.int32)
        for c in range(16):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(total[c * chunk : (c + 1) * chunk], most).astype("u1").tobytes()], pa.binary())], names=["chunk", "counts"])

    @giving_back
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "u1").astype(np.int32) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    rows = bodies.select("body").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(1 << USAGE_BITS, np.int32)
    for r in rows:
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], "<i4")
    return out


def _index(bodies: DataFrame, usage: np.ndarray, percent: int, k: int) -> DataFrame:
    """Index entries: token, key, n, place, band, four words of parity bitmap, the two shingles before (0 if none), and whether more than SMALL sets may have the shingle."""
    level = np.log2(np.maximum(usage, 1)).astype(np.uint8)
    # A slot counts all its sets, up to what a task counts at most.
    limit = int(math.log2(SMALL))
    shared = bodies.sparkSession.sparkContext.broadcast(level)

    @giving_back
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                token, offsets = _sets(part.column(1), k)
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                bits = np.bincount(row * 256 + (bw.mix(token) >> np.uint64(56)).astype(np.int64), minlength=256 * len(n)).reshape(-1, 256) & 1
                bitmap = np.packbits(bits.astype(np.uint8), axis=1).view("<i8")
                used = shared.value[(token >> np.uint64(64 - USAGE_BITS)).astype(np.int64)]
                order = np.lexsort((token, used, row))
                place = np.arange(len(token)) - offsets[row]
                keep = place < (_misses(n, percent) + 1)[row]
                r = row[keep]
                first = token[order].view(np.int64)
                before = [pa.array(np.where(place[keep] < j, 0, np.roll(first, j)[keep]), pa.int64()) for j in (1, 2)]
                band = np.floor(np.log(n[r]) / math.log(100 / percent)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[order][keep].view(np.int64)), part.column(0).take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(band), *[pa.array(np.ascontiguousarray(bitmap[r, j])) for j in range(4)], *before, pa.array(used[order][keep] >= limit)],
                    names=["token", "key", "n", "place", "band", "w0", "w1", "w2", "w3", "p1", "p2", "often"],
                )

    return bodies.select("key", "body").mapInArrow(entries, "token long, key long, n int, place int, band int, w0 long, w1 long, w2 long, w3 long, p1 long, p2 long, often boolean")


def _parities(keys: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """key, size and wide parities of the sets that have a row in keys, a stored table."""

    @giving_back
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                token, offsets = _sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(wide_parities(token, offsets), pa.binary())], names=["key", "n", "parity"])

    few = F.broadcast(keys) if keys.count() <= BROADCAST_GROUPS else keys
    return bodies.join(few, "key", "left_semi").select("key", "body").mapInArrow(made, "key long, n int, parity binary")


def _unparted(pairs: DataFrame, bodies: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (x, y; a stored table) that wide parities do not end."""

    @giving_back
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny, px, py = batch.columns
            total = nx.to_numpy().astype(np.int64) + ny.to_numpy()
            at = np.arange(batch.num_rows)
            differ = Wide(px.to_pylist() + py.to_pylist()).differ(at, at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([x, y], names=["x", "y"]).filter(pa.array(differ <= total - 2 * -(-percent * total // (100 + percent))))

    keys = materialise(pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "key"))
    known = materialise(_parities(keys, bodies, k))
    both = pairs.join(known.toDF("x", "nx", "px"), "x").join(known.toDF("y", "ny", "py"), "y")
    return both.select("x", "y", "nx", "ny", "px", "py").mapInArrow(near, "x long, y long")


def _overlaps(pairs: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """x, y with the size of their whole sets (nx, ny) and of what these have in common (both)."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                (ta, oa), (tb, ob) = _sets(part.column(2), k), _sets(part.column(3), k)
                for i in range(part.num_rows):
                    a, b = ta[oa[i] : oa[i + 1]], tb[ob[i] : ob[i + 1]]
                    found.append((len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))))
            sizes = [pa.array(c, pa.int32()) for c in (zip(*found, strict=True) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes], names=["x", "y", "nx", "ny", "both"])

    a = bodies.select(F.col("key").alias("x"), F.col("body").alias("bx"))
    b = bodies.select(F.col("key").alias("y"), F.col("body").alias("by"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "bx", "by").mapInArrow(count, "x long, y long, nx int, ny int, both int")


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.filter(F.col("both").cast("long") * 100 >= percent * (F.col("nx").cast("long") + F.col("ny") - F.col("both"))).select("x", "y")


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (x, y) whose whole sets reach the similarity."""
    return _linked(_overlaps(pairs, bodies, k), percent)


def _answers(overlaps: DataFrame) -> DataFrame:
    """Of each set the most similar leader it was compared with: lead, the size of what they have in common (over), and the leader's own (lead_n)."""
    both = overlaps.select(F.col("x").alias("key"), F.col("y").alias("lead"), F.col("both").alias("over"), F.col("ny").alias("lead_n")).union(overlaps.select("y", "x", "both", "nx"))
    best = F.max_by(F.struct("lead", "over", "lead_n"), F.struct("over", -F.col("lead")))
    return both.groupBy("key").agg(best.alias("a")).select("key", "a.*")


def _derivable(percent: int):
    """The test of two index entries of a shingle: 0 if they cannot be linked, 1 if their whole sets must be compared, 2 if they are linked by what is known of their leader."""

    def test(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, place = c["n"].astype(np.int64), c["place"]
        total = n[x] + n[y]
        least = -(-percent * total // (100 + percent))
        ok = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
        if "own" in c:
            ok &= c["own"][x] | c["own"][y]
        ok &= np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y]) >= least
        # A pair is made at its first common shingle: later lists leave it out where one of the two shingles before is common.
        for a, at_a in (("p1", 1), ("p2", 2)):
            for b, at_b in (("p1", 1), ("p2", 2)):
                ok &= ~((place[x] >= at_a) & (place[y] >= at_b) & (c[a][x] == c[b][y]))
        sure = np.zeros(len(x), bool)
        if "lead" in c:
            lead, over = c["lead"], c["over"].astype(np.int64)
            # What two sets have in common beside a third: at most what one has with it and the other without it, at least what both must have with it.
            same = (lead[x] == lead[y]) & (lead[x] >= 0)
            most = np.minimum(over[x] + n[y] - over[y], over[y] + n[x] - over[x])
            sure = same & (over[x] + over[y] - c["lead_n"][x] >= least)
            ok &= ~same | (most >= least)
            # The leader itself: the answer is there.
            ok &= (lead[x] != c["key"][y]) & (lead[y] != c["key"][x])
        x, y = x[ok], y[ok]
        # Bits of a signed number are counted without its sign.
        words = (c[f"w{j}"].view(np.uint64) for j in range(4))
        differ = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words)
        far = (total - 2 * least)[ok]
        close = differ <= far
        if "wide" in c:
            close[close] = c["wide"].differ(c["at"][x[close]], c["at"][y[close]]) <= far[close]
        ok[ok] = close
        return np.where(ok, np.where(sure, 2, 1), 0)

    return test


def _reach(percent: int):
    """Up to which place an entry's partners can stand in their sets."""

    def until(c: dict[str, np.ndarray]) -> np.ndarray:
        n = c["n"].astype(np.int64)
        # The larger of two sets has 100 n / percent shingles at most; beyond, too few places are left on either side.
        largest = n * 100 // percent
        return c["place"] + largest + -percent * (n + largest) // (100 + percent)

    return until


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Left join of a stored table on one column, in which the rows of a value that many have are dealt over several tasks by another column."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = left.count()
    # Values with more than an eighth of a partition's share: at most 8 n of them.
    rows = left.groupBy(on).agg(F.count("*").alias("n")).filter(8 * n * F.col("n") > total).filter("n > 64").collect()
    if not rows:
        return left.join(right, on, "left")
    hot = F.broadcast(left.sparkSession.createDataFrame([(r[on], -(-8 * n * r["n"] // total)) for r in rows], f"{on} long, _salts int"))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [on, "_salt"], "left").drop("_salt")


def _stars(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """The components of some links, as links from the least key of each to its other keys."""
    keys, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = number[: len(x)], number[len(x) :]
    root = np.arange(len(keys))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo < hi
        if not apart.any():
            break
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
    other = root < np.arange(len(keys))
    return pa.RecordBatch.from_arrays([pa.array(keys[root[other]], pa.int64()), pa.array(keys[other], pa.int64())], names=["x", "y"])


@giving_back
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * TASK_LINKS:
            yield _stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))
            held, rows = [], 0
    if rows:
        yield _stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))


def _fewer(links: DataFrame) -> DataFrame:
    """Links of the same components: those that meet in a task become stars.  A task has about TASK_LINKS links, so tasks grow with the links."""
    tasks = -(-links.count() // TASK_LINKS)
    stars = links.coalesce(max(1, tasks)).mapInArrow(_contracted, "x long, y long")
    return materialise(stars.distinct() if tasks > 1 else stars)


def components(links: DataFrame) -> DataFrame:
    """key and the least key of its component, for keys with a link (x, y).

    Links that meet in a task become stars first.  Then every key points to its least neighbour, pointers are
    followed to their roots, and links are drawn between roots instead, until none is left: every key with a
    lesser neighbour is gone after a round.
    """
    edges = _fewer(materialise(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x < y")))
    rounds = []
    while not edges.isEmpty():
        ends = edges.select(F.col("x").alias("key"), F.col("y").alias("other")).union(edges.select("y", "x"))
        label = materialise(ends.groupBy("key").agg(F.least("key", F.min("other")).alias("label")))
        while True:
            up = label.filter("label < key").select(F.col("key").alias("label"), F.col("label").alias("far"))
            # Labels that point further themselves; each once, so that a label which many keys have is no hot key.
            far = materialise(label.filter("label < key").select("label").distinct().join(up, "label"))
            if far.isEmpty():
                break
            label = materialise(spread_join(label, far, "label", "key").select("key", F.coalesce("far", "label").alias("label")))
        rounds.append(label)
        one = spread_join(edges, label.select(F.col("key").alias("x"), F.col("label").alias("a")), "x", "y")
        both = spread_join(materialise(one), label.select(F.col("key").alias("y"), F.col("label").alias("b")), "y", "x")
        edges = materialise(both.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x < y").distinct())
        if not edges.isEmpty():
            edges = _fewer(edges)
    if not rounds:
        return edges.select(F.col("x").alias("key"), F.col("y").alias("label"))
    label = rounds[0]
    for later in rounds[1:]:
        label = materialise(spread_join(label, later.select(F.col("key").alias("label"), F.col("label").alias("far")), "label", "key").select("key", F.coalesce("far", "label").alias("label")))
    return label


def _keyed(doc_id: str, text: str) -> list[Column]:
    """Two hashes that know a row by its id and text."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return [F.xxhash64(F.col(doc_id), body), F.hash(body, F.col(doc_id), F.lit("row"))]


def of_rows(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """What near_duplicates returns, from the rows' sets, the classes' numbers and the labels of linked classes."""
    named = classes.select("a", "b", "n", F.col("number").alias("key")).join(label, "key", "left").select("a", "b", "n", F.coalesce("label", "key").alias("label"))
    known = rows.select("key", "tag", "a", "b", "n").distinct().join(named, ["a", "b", "n"], "left").select("key", "tag", "n", "label")
    key, tag = _keyed(doc_id, text)
    found = materialise(docs.select(key.alias("key"), tag.alias("tag"), F.col(doc_id).alias("doc")).join(known, ["key", "tag"]))
    least = found.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc").alias("component"))
    done = spread_join(found, least, "label", "key")
    return done.select("key", "tag", "doc", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"), "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """key, tag (hashes of id and text), doc (the id as given), n_shingles, component (least id reachable by links) and label of every row.

    The label is the component's own, the least number of its classes, and null for empty sets: unlinked components may have one least id.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key, tag = _keyed(doc_id, text)
    keyed = docs.select(key.alias("key"), tag.alias("tag"), body.alias("body"))
    targets = group_count(keyed, "body", n)
    groups = GROUPS * targets
    sent = keyed.mapInArrow(_send_first(groups, targets, percent, k), "grp int, data binary")
    shared = sent.groupBy("grp").applyInArrow(_count_shared(targets), "target int, info boolean, data binary")
    rows = materialise(shared.groupBy("target").applyInArrow(_per_document(percent), "key long, tag int, n int, a long, b long, alive boolean"))
    first = F.min(F.struct("key", "tag")).alias("first")
    classes = rows.filter("n > 0").groupBy("a", "b", "n").agg(first, F.max("alive").alias("alive")).select("a", "b", "n", "first.key", "first.tag", "alive")
    # Stored with their numbers, so that these stay as they are.
    classes = materialise(classes.withColumn("number", F.monotonically_increasing_id()))
    bodies = keyed.join(classes.filter("alive").select("key", "tag", "number"), ["key", "tag"]).select(F.col("number").alias("key"), "body")
    bodies = materialise(bodies.dropDuplicates(["key"]))
    index = materialise(_index(bodies, _usage(bodies, k), percent, k))

    # Short lists, where they meet; the long ones and those of near copies stay.
    long = materialise(index.filter("often").groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") > SMALL).select("token"))
    few = F.broadcast(long) if long.count() <= BROADCAST_GROUPS else long
    index = index.drop("often")
    told = materialise(settled(index.join(few, "token", "left_anti"), "token", "place", _reach(percent), _derivable(percent)))
    index = materialise(index.join(few, "token", "left_semi").union(told.filter("x IS NULL").select(index.columns)))
    # Parities of 256 bits are full in large sets: wider ones, each set's once, before texts are sent.
    met = _unparted(materialise(told.filter("x IS NOT NULL").select("x", "y").distinct()), bodies, percent, k)

    # Leaders: one pass that is linear in the entries.
    rest = ("place", "w0", "w1", "w2", "w3")
    by_key, by_size = F.struct("key", "n", *rest), F.struct("n", "key", *rest)
    heads = index.groupBy("token", "band").agg(F.min(by_key).alias("a"), F.max(by_key).alias("b"), F.min(by_size).alias("c"), F.max(by_size).alias("d"), F.count("*").alias("entries")).filter("entries > 1")
    pick = F.explode(F.array(*[F.struct(*[F.col(f"{h}.{c}").alias(c) for c in ("key", "n", *rest)]) for h in "abcd"]))
    led = index.alias("x").join(heads, ["token", "band"]).select("x.*", pick.alias("y")).filter("key <> y.key").filter(_possible_flat(percent))
    pairs = led.select(F.least("key", "y.key").alias("x"), F.greatest("key", "y.key").alias("y"), F.lit(True).alias("led")).union(met.select("x", "y", F.lit(False)))
    pairs = materialise(pairs.groupBy("x", "y").agg(F.max("led").alias("led")))
    seen = materialise(_overlaps(pairs, bodies, k))
    links = _linked(seen, percent)
    label = components(links)

    # Then only pairs of different components, in lists that hold any: by position, and with what the leaders' answers tell.
    zero = {c: F.coalesce(c, F.lit(z)) for c, z in (("lead", -1), ("over", 0), ("lead_n", 0))}
    answers = _answers(seen.join(pairs.filter("led"), ["x", "y"], "left_semi"))
    open_ = materialise(_mixed(index, label).join(answers, "key", "left").withColumns(zero))
    parities = materialise(_parities(materialise(open_.select("key").distinct()), bodies, k).select("key", "parity"))
    tried, most = None, MOST
    while True:
        entries = open_.withColumn("block", F.explode(F.array("band", F.col("band") - 1))).withColumn("own", F.col("block") == F.col("band")).drop("band")
        more = materialise(compared(entries, ["token", "block"], "place", _reach(percent), _derivable(percent), TILE, parities, most))
        sure, pairs = more.filter("mark = 2").select("x", "y"), more.filter("mark = 1").select("x", "y")
        fresh = pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti")
        links = materialise(links.union(sure).union(_verified(fresh, bodies, percent, k)))
        label = components(links)
        if more.filter("mark = 0").isEmpty():
            return of_rows(docs, doc_id, text, rows, classes, label)
        tried = pairs if tried is None else tried.union(fresh)
        open_, most = materialise(_mixed(open_.drop("label"), label)), most * MORE


def _mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """The index entries with their component's label, of lists that hold different ones."""
    marked = entries.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    return marked.join(mixed, "token")


def _possible_flat(percent: int) -> Column:
    """Whether an index entry and its leader (the struct column y) can belong to linked sets, by sizes, places and bitmaps."""
    total = "(n + y.n)"
    least = f"CAST(ceil({percent} * {total} / {100.0 + percent}D - 1e-9D) AS INT)"
    differ = " + ".join(f"bit_count(w{j} ^ y.w{j})" for j in range(4))
    return F.expr(f"least(n, y.n) * 100 >= greatest(n, y.n) * {percent} AND least(place, y.place) + least(n - place, y.n - y.place) >= {least} AND {differ} <= {total} - 2 * {least}")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """docs with one row of each component, the one with the least id; rows without a word all stay."""
    found = near_duplicates(docs, doc_id, text, percent, k)
    row = F.struct(F.col("doc").isNull(), "doc", "key", "tag")
    best = found.filter("n_shingles > 0").groupBy("label").agg(F.min(row).alias("first")).select("first.key", "first.tag", F.lit(True).alias("once"))
    lone = found.filter("n_shingles = 0").select("key", "tag", F.lit(False).alias("once")).distinct()
    key, tag = _keyed(doc_id, text)
    # The user's columns travel in one struct, so that none of them clashes with ours.
    kept = docs.select(key.alias("key"), tag.alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(best.union(lone), ["key", "tag"])
    return kept.filter("once").dropDuplicates(["key", "tag"]).union(kept.filter("NOT once")).select("row.*")


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.met = l.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.met) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
