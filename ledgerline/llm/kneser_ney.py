"""Language identification by interpolated Kneser-Ney character models.

Each language gets a model over windows of four characters (letters made small, all
else one blank).  A window is one 64-bit key of four 16-bit characters, so the keys of
its context and of its lower orders are shifts and masks of it; counts and probabilities
lie in arrays sorted by key.  Counts of all orders, discounts and totals of contexts cover every
training text and are made by Spark.  The model, not the corpus, is bounded: every language has
an equal share of MAX_WINDOWS windows of each order, MOST_KEPT at most, and keeps its most frequent
ones; what a context loses so goes to the lower order, so that its probabilities still add up to
one.  With few languages the arrays have a column for each; with many (beyond DENSE_CELLS cells)
they list only the languages that have a window, so that their size grows with the windows and not
with the square of the languages.  Both give the same probabilities.

A text gets the language with the lowest cross-entropy a character.  The score is a soft
minimum over the languages; its sharpness, and the entropy above which a text is marked
rejected (one in REJECTED of its language), are set on about CALIBRATION_ROWS labelled training
texts, a tenth of them at most.  These are an equal share of the hash range of texts and are left out
of the counts, with all their copies.  A language with fewer than REJECTED of them has the entropy
from an exponential tail beyond its median.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language first in order; no training rows make every text ``und``; repeated rows
get equal rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import slices
from .shared import giving_back, materialise

ORDER = 4
#: Windows of each order in the model, over all languages, and of one language at most.
MAX_WINDOWS, MOST_KEPT = 8_000_000, 1_000_000
#: Cells (windows times languages) of an order up to which it has a column for each language.
DENSE_CELLS = 16_000_000
CALIBRATION_ROWS, CALIBRATION_SHARE, REJECTED = 10_000, 0.1, 1_000
UNKNOWN = "und"

_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each 16-bit character whether it is a letter or mark; 2 for letters."""
    if not _table:
        kinds = [unicodedata.category(chr(i))[0] for i in range(1 << 16)]
        _table.append(np.array([2 if k == "L" else 1 if k == "M" else 0 for k in kinds], np.uint8))
    return _table[0]


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows that end at each character, the row of each, and whether each row has a letter."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    n = len(texts)
    lens = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), lens)
    wide = np.flatnonzero(points > 0xFFFF)
    known, which = np.unique(points[wide], return_inverse=True)
    points = np.where(points > 0xFFFF, np.uint32(0xFFFF), points).astype(np.uint16)
    kind = _letters()[points]
    # Characters beyond 16 bits share one key.
    kind[wide] = np.array([2 * (unicodedata.category(chr(c))[0] == "L") for c in known.tolist()], np.uint8)[which]
    has = np.zeros(n, bool)
    has[row[kind == 2]] = True
    chars = np.where(kind > 0, points, np.uint16(0x20))
    blank = kind == 0
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    chars, row = chars[keep], row[keep]
    # Three blanks before each text pad the contexts of its first characters.
    shift = (np.arange(n) + 1) * (ORDER - 1)
    padded = np.full(len(chars) + n * (ORDER - 1), 0x20, np.uint64)
    at = np.arange(len(chars)) + shift[row] if len(chars) else np.zeros(0, np.int64)
    padded[at] = chars
    keys = np.zeros(len(chars), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        keys = (keys << np.uint64(16)) | padded[at - k]
    return keys, row, has


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def window_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """How often each window occurs in the texts of each language: lang, key, n."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                held[name] = [(keys, n)]
                yield name, keys, n

        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                keys, row, _ = windows(part.column(0))
                names, number = np.unique(np.array(part.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = number[row]
                for k, name in enumerate(names):
                    held.setdefault(name, []).append(_summed(keys[of == k]))
                    size += len(held[name][-1][0])
            if size > 4_000_000:
                size = sum(len(k) for _, k, _ in flush())
        for name, keys, n in flush():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    parts = docs.select(text, F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, key long, n long")
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


#: Of one order and language: sorted keys, their counts, the counts of their whole contexts, and the discount.
Grams = tuple[np.ndarray, np.ndarray, np.ndarray, float]


class _Language:
    """One language's interpolated probabilities of all orders, while the model is made."""

    def __init__(self, grams: list[Grams], floor: float):
        self.floor = np.float32(np.log(floor))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys, log probabilities
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # contexts, log weight of the lower order
        for k, (keys, n, total, d) in enumerate(grams, 1):
            contexts, own = np.unique(keys >> np.uint64(16), return_inverse=True)
            sure = np.maximum(n - d, 0) / total
            # What the windows at hand do not take; without any left out, discount times kinds over total.
            back = np.maximum(1 - np.bincount(own, sure, len(contexts)), 1e-9)
            lower = np.exp(self.log_p(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1).astype(np.float64))
            self.levels.append((keys, np.log(back[own] * lower + sure).astype(np.float32)))
            self.backoff.append((contexts, np.log(back).astype(np.float32)))

    def log_p(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), self.floor, np.float32)
        out, missed = _found(self.levels[k - 1], keys)
        rest = keys[missed]
        out[missed] = self.log_p(rest & np.uint64((1 << 16 * (k - 1)) - 1), k - 1) + _found(self.backoff[k - 1], rest >> np.uint64(16))[0]
        return out


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, 0 where there is none, and the places without."""
    known, value = table
    if not len(known):
        return np.zeros(len(keys), np.float32), np.arange(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, value[at], np.float32(0)), np.flatnonzero(~hit)


class _Listed:
    """For sorted keys, the languages that have each and their values, one key after another."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([p[0] for p in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p[0]) for p in parts])
        order = np.lexsort((lang, keys))
        self.lang, self.value = lang[order], np.concatenate([p[1] for p in parts])[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, language and value of all entries of the keys."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        many = np.where(self.keys[at] == keys, self.first[at + 1] - self.first[at], 0)
        row = np.repeat(np.arange(len(keys)), many)
        spot = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.first[at][row]
        return row, self.lang[spot], self.value[spot]


class Model:
    """Interpolated probabilities of all languages, looked up by sorted key."""

    def __init__(self, langs: list[str], grams: dict[int, list[Grams]], dense_cells: int = DENSE_CELLS):
        self.langs = langs
        size = len(langs)
        letters = np.unique(np.concatenate([g[0] for g in grams[1]]))
        self.floor = 1.0 / (len(letters) + 1)
        models = [_Language([grams[k][j] for k in range(1, ORDER + 1)], self.floor) for j in range(size)]
        unions = [np.unique(np.concatenate([m.levels[k][0] for m in models])) for k in range(ORDER)]
        self.dense = max(map(len, unions)) * size <= dense_cells
        self.levels: list = []  # with a column for each language: keys, log probabilities; else what is listed
        self.backoff: list = []  # contexts, log weight of the lower order
        for k in range(ORDER):
            if self.dense:
                keys, contexts = unions[k], np.unique(unions[k] >> np.uint64(16))
                self.levels.append((keys, np.stack([m.log_p(keys, k + 1) for m in models], axis=1)))
                self.backoff.append((contexts, np.stack([_found(m.backoff[k], contexts)[0] for m in models], axis=1)))
            else:
                self.levels.append(_Listed([m.levels[k] for m in models]))
                self.backoff.append(_Listed([m.backoff[k] for m in models]))

    def log_p(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probability in each language of the last character of each gram of k characters."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), np.log(self.floor), np.float32)
        mask = np.uint64((1 << 16 * (k - 1)) - 1)
        if not self.dense:
            out = self.log_p(keys & mask, k - 1)
            row, lang, value = self.backoff[k - 1].entries(keys >> np.uint64(16))
            out[row, lang] += value
            row, lang, value = self.levels[k - 1].entries(keys)
            out[row, lang] = value
            return out
        known, value = self.levels[k - 1]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = value[at]
        missed = np.flatnonzero(known[at] != keys)
        if len(missed):
            rest = keys[missed]
            low = self.log_p(rest & mask, k - 1)
            contexts, weight = self.backoff[k - 1]
            c = rest >> np.uint64(16)
            spot = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            out[missed] = low + np.where((contexts[spot] == c)[:, None], weight[spot], np.float32(0))
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a character of each row in each language, its characters, and whether it has a letter."""
        keys, row, has = windows(column)
        n = len(has)
        chars = np.bincount(row, minlength=n)
        sums = np.zeros((n, len(self.langs)))
        step = max(1, min(1 << 18, (1 << 22) // len(self.langs)))
        for lo in range(0, len(keys), step):
            p = self.log_p(keys[lo : lo + step], ORDER)
            r = row[lo : lo + step]
            for j in range(len(self.langs)):
                sums[:, j] -= np.bincount(r, p[:, j], n)
        return sums / np.maximum(chars, 1)[:, None], chars, has


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one and two else 0.5


def gram_counts(windows: DataFrame) -> DataFrame:
    """Of window counts (lang, key, n): grams of all orders (k, lang, key, n, total); below the highest order n says in how many different grams one longer a gram is the end."""
    orders = [windows.select(F.lit(ORDER).alias("k"), "lang", "key", "n")]
    for k in range(ORDER - 1, 0, -1):
        ends = orders[-1].select("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("key"))
        orders.append(ends.groupBy("lang", "key").agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "lang", "key", "n"))
    both = orders[0]
    for o in orders[1:]:
        both = both.union(o)
    return both.withColumn("total", F.sum("n").over(Window.partitionBy("k", "lang", F.shiftrightunsigned("key", 16))))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_windows: int = MAX_WINDOWS, dense_cells: int = DENSE_CELLS) -> Model | None:
    """The models of all languages with a row of text; counts come from every row."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    grams = materialise(gram_counts(materialise(window_counts(rows, text, lang))))
    # Sizes of levels of use, some hundreds a language and order, with the counts one and two for the discounts.
    level = F.floor(16 * F.log2("n")).cast("int").alias("level")
    shape = grams.groupBy("lang", "k", level).agg(F.count("*").alias("kinds")).collect()
    if not shape:
        return None
    langs = sorted({r["lang"] for r in shape})
    share = min(MOST_KEPT, max(1, max_windows // len(langs)))
    kinds: dict[tuple, dict[int, int]] = {}
    for r in shape:
        kinds.setdefault((r["lang"], r["k"]), {})[r["level"]] = r["kinds"]
    least = []
    for (name, k), levels in kinds.items():
        kept, low = 0, max(levels)
        for at in sorted(levels, reverse=True):
            kept += levels[at]
            if kept > share:
                break
            low = at
        least.append((name, k, low))
    bounds = docs.sparkSession.createDataFrame(least, "lang string, k int, low int")
    table = grams.join(F.broadcast(bounds), ["lang", "k"]).filter(F.floor(16 * F.log2("n")) >= F.col("low")).select("k", "lang", "key", "n", "total").toArrow()  # orders x languages rows; a model of bounded size
    k, names, keys, n, total = (table.column(c).to_numpy() for c in ("k", "lang", "key", "n", "total"))
    out: dict[int, list[Grams]] = {}
    for order in range(1, ORDER + 1):
        for name in langs:
            own = np.flatnonzero((k == order) & (names == name))
            own = own[np.argsort(keys[own].view(np.uint64))]
            seen = kinds[name, order]
            out.setdefault(order, []).append((keys[own].view(np.uint64), n[own], total[own], _discount(seen.get(0, 0), seen.get(16, 0))))
    return Model(langs, out, dense_cells)


def _calibrated(model: Model, docs: DataFrame, text: str, lang: str) -> tuple[float, np.ndarray]:
    """Sharpness of the score with the least log loss, and for each language the entropy that one of its texts in REJECTED exceeds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                e, chars, has = shared.value.entropies(part.column(0))
                ok = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(ok)), pa.array(list(e[ok]), pa.list_(pa.float64())), pa.array(chars[ok])], names=["lang", "e", "chars"])

    once = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang")).groupBy(F.xxhash64("t").alias("h"), "lang").agg(F.first("t").alias("t"))
    found = [r for r in once.select("t", "lang").mapInArrow(measure, "lang string, e array<double>, chars long").collect() if r["lang"] in model.langs]
    limit = np.full(len(model.langs), np.inf)
    if not found:
        return 0.2, limit
    e, chars, right = np.array([r["e"] for r in found]), np.array([r["chars"] for r in found]), np.array([model.langs.index(r["lang"]) for r in found])
    loss = {t: float(-np.log(np.maximum(_soft(e, chars, t)[np.arange(len(e)), right], 1e-9)).mean()) for t in (0.05, 0.1, 0.2, 0.4, 0.8, 1.0)}
    for j in range(len(model.langs)):
        if (right == j).any():
            limit[j] = _exceeded_by_few(e[right == j, j])
    return min(loss, key=loss.get), limit


def _exceeded_by_few(e: np.ndarray) -> float:
    """The entropy that one text in REJECTED exceeds: as observed, or with fewer texts from an exponential tail beyond the median, no lower than the highest."""
    highest = float(np.quantile(e, 1 - 1 / REJECTED, method="higher"))
    if len(e) >= REJECTED:
        return highest
    middle = float(np.median(e))
    return max(highest, middle + max(float((e[e >= middle] - middle).mean()), 0.02 * middle) * float(np.log(REJECTED / 2)))


def _soft(e: np.ndarray, chars: np.ndarray, sharp: float) -> np.ndarray:
    """Weights of the languages by their entropy over the whole text, damped by the calibrated sharpness."""
    gap = (e - e.min(axis=1, keepdims=True)) * np.maximum(chars, 1)[:, None] * sharp
    w = np.exp(-np.minimum(gap, 700))
    return w / w.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", calibration_rows: int = CALIBRATION_ROWS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for every row, by models of the rows where train holds."""
    kind = docs.schema[doc_id].dataType.simpleString()
    labelled = docs.filter(train & F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = min(CALIBRATION_SHARE, calibration_rows / max(1, labelled.count()))
    held = F.pmod(F.xxhash64(text), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    model = fit(labelled.filter(~held), text, lang, max_windows)
    sharp, limit = _calibrated(model, labelled.filter(held), text, lang) if model else (1.0, np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast((model, sharp, limit))

    @giving_back
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sharp, limit = shared.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                n = part.num_rows
                if model is None:
                    name, score, best, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                else:
                    e, chars, has = model.entropies(part.column(1))
                    first = e.argmin(axis=1)
                    best = np.where(has, e[np.arange(n), first], 0.0)
                    score = np.where(has, _soft(e, chars, sharp)[np.arange(n), first], 0.0)
                    rejected = ~has | (best > limit[first])
                    name = [model.langs[j] if ok else UNKNOWN for j, ok in zip(first, has, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(best), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(doc_id, text).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    found = identify(docs, ~held_out("doc_id"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), "entropy", "rejected")
