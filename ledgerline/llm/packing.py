"""Best-fit packing of tokenised documents by bin-completion branch and bound.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is
planned: a plan is a list of fillings, each a multiset of lengths with the number of
sequences filled that way.  Best-fit decreasing gives the incumbent.  If it uses more
sequences than the lower bound, bin completion takes the largest length left, tries every
undominated filling around it from the least waste on, any number of times that the counts
allow, and gives up a branch once its waste exceeds what a better plan may waste, or once
the same lengths were left after as few sequences before.  A better plan becomes the
incumbent, until the bound is met or nothing is left to try: then the plan is a proven optimum.
Bin packing is hard, so the search has a budget (BUDGET steps); ``budget=None`` searches to
the end.  ``plan`` says whether its plan is proven.

Pieces then take the places of their length by rank; ranks come from counts by length and
salt, and a length has as many salts as its count needs, so that a length held by a third of
all pieces is dealt over groups of about GROUP_ROWS rows.

Defined cases: a null or empty text is one piece with the end token alone; a document
longer than ``capacity`` is cut into pieces of ``capacity`` and a rest; repeated rows are
packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .exchange import slices
from .shared import giving_back, materialise

CAPACITY = 4096
END_TOKEN = 1
#: Rows of one length that are ranked in one group, about: at most so many, and fewer where partitions are smaller.
GROUP_ROWS = 50_000
#: Entries of a worker's table of known word pieces; it starts anew beyond them.
KNOWN_PIECES = 600_000
#: Bytes of text tokenised at a time.
SLICE = 1 << 20
#: Lengths and fillings that the search looks at before the incumbent stands; some seconds of the driver.
BUDGET = 3_000_000
#: Branching points above the current one whose fillings are held in memory.
LIVE = 8


class WordTokens:
    """Ids of whole texts by a vocabulary file whose tokens never span white space.

    Words of ASCII and Latin-1 letters, digits and ASCII punctuation are cut where the
    vocabulary's own expression cuts them and looked up once each; every other word
    (apostrophes, control characters, any other script) goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Keys in order, place of the ids, number of ids: a large table, and a small one that takes what is new.
        self.old, self.young = empty, empty
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and n + 1 offsets."""
        data, offsets = bw.raw_bytes(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        lowered, start, end, hard = _pieces(data, offsets)
        keys = bw.hash_spans(lowered, start, end)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at, count = (x[inverse] for x in self._places(distinct, first, lowered, start, end, hard))
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(at - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        row = np.searchsorted(offsets, start, side="right") - 1
        sizes = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _places(self, distinct, first, data, start, end, hard) -> tuple[np.ndarray, np.ndarray]:
        if len(self.old[0]) > KNOWN_PIECES:
            self._forget()
        at, count, known = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for keys, places, counts in (self.old, self.young):
            if len(keys):
                k = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[k] == distinct
                at[hit], count[hit] = places[k[hit]], counts[k[hit]]
                known |= hit
        new = np.flatnonzero(~known)
        if len(new):
            at[new], count[new] = self._learn([data[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], hard[first[new]])
            self.young = _united(self.young, (distinct[new], at[new], count[new]))
            if len(self.young[0]) > max(50_000, len(self.old[0]) // 4):
                self.old, self.young = _united(self.old, self.young), tuple(x[:0] for x in self.young)
        return at, count

    def _learn(self, text: list[bytes], hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(len(text), np.int64)
        at = np.zeros(len(text), np.int64)
        easy, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        for k in range(0, len(easy), 1000):
            part = easy[k : k + 1000]
            e = self.bare.encode_batch([b" ".join([text[i] for i in part]).decode("utf-8")], add_special_tokens=False)[0]
            count[part] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            at[part] = self._keep(np.array(e.ids, np.uint32)) + np.cumsum(count[part]) - count[part]
        for i, e in zip(rest, self.whole.encode_batch_fast([text[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
            count[i], at[i] = len(e.ids), self._keep(np.array(e.ids, np.uint32))
        return at, count

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at : self.used] = ids
        return at


def _united(a: tuple, b: tuple) -> tuple:
    joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(joined[0])
    return tuple(x[order] for x in joined)


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, and the start, end and hardness of each piece."""
    kind = _KIND[data]
    high = data >= 0x80
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    fine = after_c3 & high & (data != 0x97) & (data != 0xB7)
    lead = np.zeros(len(data), bool)
    lead[:-1] = fine[1:] & (data[:-1] == 0xC3)
    bad = (high & ~(fine | lead)) | (kind == 4)
    lowered = bw._LOWER[data]
    lowered[fine & (data <= 0x9E)] += 0x20
    inside = kind > 0
    row_start = np.zeros(len(data), bool)
    cuts = offsets[:-1]
    row_start[cuts[cuts < len(data)]] = True
    word = inside.copy()
    word[1:] &= ~inside[:-1] | row_start[1:]
    number = np.cumsum(word) - 1
    hard_word = np.zeros(int(number[-1]) + 1 if len(number) and number[-1] >= 0 else 0, bool)
    hard_word[number[bad]] = True
    cut = word.copy()
    cut[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~hard_word[np.maximum(number[1:], 0)] if len(hard_word) else False
    start = np.flatnonzero(cut)
    # A piece ends where the next one starts, or at the end of its word.
    stop = np.ones(len(data), bool)
    stop[:-1] = cut[1:] | ~inside[1:] | row_start[1:]
    end = np.flatnonzero(stop & inside) + 1
    return lowered, start, end, hard_word[number[start]] if len(start) else np.zeros(0, bool)


#: 0 blank, 1 letter or byte of a longer character, 2 digit, 3 punctuation, 4 apostrophe or control.
_KIND = np.full(256, 3, np.uint8)
_KIND[:32] = 4
_KIND[[0x27, 0x7F]] = 4
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1

_loaded: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def tokenised(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                flat, offsets = encoder.encode(part.column(1))
                n = part.num_rows
                full = np.empty(len(flat) + n, "<u4")
                keep = np.ones(len(full), bool)
                last = offsets[1:] + np.arange(n)
                keep[last] = False
                full[keep], full[last] = flat, end_token
                bounds = offsets + np.arange(n + 1)
                sizes = np.diff(bounds)
                pieces = (sizes + capacity - 1) // capacity
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                raw = memoryview(full.tobytes())
                at = (bounds[row] + start) * 4
                spans = [raw[a : a + 4 * b] for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


Plan = list[tuple[list[tuple[int, int]], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: equal sequences are kept as one entry with a number."""
    open_: dict[int, Plan] = {}
    done: Plan = []

    def put(room: int, filling: list[tuple[int, int]], times: int) -> None:
        (open_.setdefault(room, []) if room else done).append((filling, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            while left and open_.get(room):
                filling, times = open_[room].pop()
                each = room // size
                whole = min(times, left // each)
                if whole:
                    put(room - each * size, [*filling, (size, each)], whole)
                    left -= whole * each
                if whole < times:
                    some = min(left, each)
                    if some:
                        put(room - some * size, [*filling, (size, some)], 1)
                        left -= some
                    if times - whole - (some > 0):
                        put(room, filling, times - whole - (some > 0))
                    if not left:
                        break
            if not open_.get(room):
                open_.pop(room, None)
            if not left:
                break
        each = capacity // size
        if left // each:
            put(capacity - each * size, [(size, each)], left // each)
        if left % each:
            put(capacity - left % each * size, [(size, left % each)], 1)
    return done + [x for group in open_.values() for x in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """As many sequences as any plan needs: by volume, and by the lengths over half that what fits beside them cannot fill."""
    best = -(-sum(s * c for s, c in counts.items()) // capacity)
    sizes = sorted(s for s, c in counts.items() if c)
    for k in [0, *(s for s in sizes if 2 * s <= capacity)]:
        alone = sum(counts[s] for s in sizes if s > capacity - k)
        half = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        small = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * counts[s] for s in half)
        best = max(best, alone + sum(counts[s] for s in half) + max(0, -(-(small - room) // capacity)))
    return best


def _dominated(filling: list[tuple[int, int]], counts: dict[int, int], sizes: list[int], waste: int) -> bool:
    """Whether some of the items, or none, could make place for one item left over that is as large as they are together, or larger."""
    one = more = 0  # bit sets of the sums of one item, and of two or more
    for s, many in filling:
        for _ in range(many):
            more |= (more << s) | (one << s)
            one |= 1 << s
    used = dict(filling)
    for y in sizes:
        if counts[y] > used.get(y, 0):
            low = max(0, y - waste)
            if y <= waste or (more >> low) & ((1 << (y - low + 1)) - 1) or (one >> low) & ((1 << (y - low)) - 1):
                return True
    return False


def fillings(counts: dict[int, int], room: int, most_waste: int, steps: list[int] | None = None) -> Iterator[list[tuple[int, int]]]:
    """All undominated fillings of the room that waste so much at most, least waste first; steps[0] counts what was looked at."""
    steps = [0] if steps is None else steps
    if counts.get(room):
        yield [(room, 1)]  # as good as any other
        return
    sizes = sorted((s for s, c in counts.items() if c and s <= room), reverse=True)
    # Bit sets of the sums that the lengths from each place on can give.
    sums = [1]
    mask = (1 << (room + 1)) - 1
    for s in reversed(sizes):
        reach, many, step = sums[-1], min(counts[s], room // s), 1
        while many:
            step = min(step, many)
            reach |= (reach << s * step) & mask
            many, step = many - step, step * 2
        sums.append(reach)
    sums.reverse()
    steps[0] += len(sizes)

    def exact(k: int, rest: int) -> Iterator[list[tuple[int, int]]]:
        if rest == 0:
            yield []
            return
        while k < len(sizes):
            steps[0] += 1
            if not sums[k] >> rest & 1:
                return
            s = sizes[k]
            for many in range(min(counts[s], rest // s), 0, -1):
                if sums[k + 1] >> (rest - many * s) & 1:
                    for tail in exact(k + 1, rest - many * s):
                        yield [(s, many), *tail]
            k += 1

    for waste in range(min(most_waste, room) + 1):
        if sums[0] >> (room - waste) & 1:
            for filling in exact(0, room - waste):
                steps[0] += len(filling)
                if not _dominated(filling, counts, sizes, waste):
                    yield filling


def plan(counts: dict[int, int], capacity: int = CAPACITY, budget: int | None = BUDGET) -> tuple[Plan, bool]:
    """Fillings and their numbers, never more sequences than best fit, and whether fewer are proven impossible."""
    best = best_fit(counts, capacity)
    used = sum(times for _, times in best)
    bound = lower_bound(counts, capacity)
    if used <= bound:
        return best, True
    total = sum(s * c for s, c in counts.items())
    left = {s: c for s, c in counts.items() if c}
    trail: Plan = []
    seen: dict[bytes, int] = {}  # fewest sequences after which these lengths (their digest) were left
    steps = [0]

    def take(filling: list[tuple[int, int]], times: int) -> None:
        for s, k in filling:
            left[s] = left.get(s, 0) - k * times
            if not left[s]:
                del left[s]

    def options(waste: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """Fillings around the largest length left, each as often as can be and then ever less often."""
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        for f in fillings(rest, capacity - top, (used - 1) * capacity - total - waste, steps):
            whole = dict(f)
            whole[top] = whole.get(top, 0) + 1
            for times in range(min((rest[s] + (s == top)) // k for s, k in whole.items()), 0, -1):
                yield list(whole.items()), times

    # Sequences and waste so far, length of the trail, how much has been tried, and what is still to try; made anew where the search comes back from far below.
    choices: list[list] = [[0, 0, 0, 0, options(0)]]
    while choices:
        if budget is not None and steps[0] > budget:
            return best, False
        made, waste, depth, tried, tries = choices[-1]
        while len(trail) > depth:
            take(trail[-1][0], -trail.pop()[1])
        if tries is None:
            choices[-1][4] = tries = islice(options(waste), tried, None)
        chosen = next(tries, None)
        choices[-1][3] += 1
        steps[0] += 1
        if chosen is None:
            choices.pop()
            continue
        filling, times = chosen
        lost = waste + (capacity - sum(s * k for s, k in filling)) * times
        if lost > (used - 1) * capacity - total:
            continue
        take(filling, times)
        trail.append(chosen)
        if not left:
            best, used = list(trail), made + times
            if used <= bound:
                return best, True
            continue
        state = hashlib.blake2b(np.array(sorted(left.items()), np.int64).tobytes(), digest_size=16).digest()
        steps[0] += len(left)
        if seen.get(state, used) <= made + times:
            continue
        seen[state] = made + times
        choices.append([made + times, lost, len(trail), 0, options(lost)])
        if len(choices) > LIVE:
            choices[-1 - LIVE][4] = None
    return best, True


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int | None = None, budget: int | None = BUDGET) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...), and whether the plan is proven to need the fewest sequences; pieces is read several times, so give a stored table."""
    spark = pieces.sparkSession
    kept = pieces.columns
    total = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        total[r["length"]] = r["n"]
    if not total.any():
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("proven"))
    # Each length has its own slots, one for about group_rows rows; pieces get one of them by hash.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_rows = group_rows or min(GROUP_ROWS, max(64, int(total.sum()) // (8 * n)))
    salts = -(-total // group_rows)
    slot = np.cumsum(salts) - salts
    slots = spark.createDataFrame([(int(s), int(salts[s]), int(slot[s])) for s in np.flatnonzero(total)], "length long, salts int, slot int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("salts")).cast("int")
    pieces = pieces.join(F.broadcast(slots), "length").withColumn("slot", F.col("slot") + salt).drop("salts")  # capacity rows at most
    in_slot = np.zeros(int(salts.sum()), np.int64)
    for r in pieces.groupBy("slot").agg(F.count("*").alias("n")).collect():  # one row for group_rows pieces
        in_slot[r["slot"]] = r["n"]
    ends, each, number, offset = [], [], [], []
    taken: dict[int, list] = {}
    sequence = 0
    fillings, proven = plan({s: int(total[s]) for s in np.flatnonzero(total).tolist()}, capacity, budget)
    for filling, times in fillings:
        at = 0
        for s, k in filling:
            taken.setdefault(s, []).append((times * k, k, sequence, at))
            at += s * k
        sequence += times
    at = 0
    for s in sorted(taken):
        for n, k, seq, off in taken[s]:
            at += n
            ends.append(at)
            each.append(k)
            number.append(seq)
            offset.append(off)
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (ends, each, number, offset)))
    starts = spark.sparkContext.broadcast(np.cumsum(in_slot) - in_slot)
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("doc_id", "piece", "start")))

    @giving_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, each, number, offset = table.value
        for batch in batches:
            length, slot, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "slot", "rank"))
            at = starts.value[slot] + rank - 1
            k = np.searchsorted(ends, at, side="right")
            begin = np.where(k > 0, ends[np.maximum(k - 1, 0)], 0)
            copy, turn = np.divmod(at - begin, each[k])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(number[k] + copy), pa.array(offset[k] + turn * length)], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").withColumn("proven", F.lit(bool(proven)))


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return packed(materialise(tokenised(docs, tokenizer, doc_id, text, capacity)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
