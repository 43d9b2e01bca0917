"""Secrets: fixed formats by expression, and values in a credential context by their guess cost.

The guess cost of a value is the least sum, over all cuts into words, dates, repeats,
keyboard walks and brute-force characters, of the logarithms of the guesses for each
part; one dynamic program over the value finds it.  A value that stands where a
credential stands is reported if no cheap cut explains it; the cost alone decides.

The words are the corpus's own: letters in a row, ranked by the number of documents that
have them outside credential contexts, WORD_LIST of them at most, with the fixed password
words of WORDS beside them.  A word's rank is the number of its guesses.  The list is
counted over all documents and has a bounded size, so it is broadcast.

Defined cases: a null or empty text has no spans and no words; repeated rows get equal rows
and count once each; an empty table gives an empty one; other columns are not read.  Spans of
different kinds may overlap; those of one base kind do not.  Ties in rank go by the word.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import giving_back, materialise

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Where a credential may stand besides ASSIGN; group 1 is the value.
_CONTEXT = r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|client[_-]?secret|credentials?|auth|bearer)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]{8,})"""
CONTEXT = re.compile(_CONTEXT, re.ASCII | re.IGNORECASE)
KINDS = ("assign", "access", "hex", "guess")
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Reported if the cheapest cut needs 10 to this power guesses or more: above two rare words and a character between them.
MIN_COST = 11.0
#: Costs are counted up to this power; a dearer value has it.
MAX_COST = 40.0
#: Words of the corpus that are kept, and the documents and letters that one needs.
WORD_LIST, WORD_DOCS, WORD_LETTERS = 50_000, 2, (3, 24)
#: Ends that are tried within a repeat or walk, besides its last.
REACH = 64

# Common password words, in order of rank.
WORDS = (
    "password", "admin", "welcome", "login", "master", "dragon", "monkey", "letmein", "shadow", "sunshine",
    "princess", "football", "baseball", "superman", "secret", "access", "hello", "freedom", "whatever", "trust",
    "test", "user", "guest", "root", "default", "changeme", "example", "sample", "demo", "your",
    "here", "token", "key", "api", "pass", "word", "value", "string", "null", "none",
    "true", "false", "insert", "replace", "placeholder", "summer", "winter", "spring", "autumn", "love",
)
# Rows of the keyboard, and the alphabet.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@31!05$7", "aaeiioss" + "t")
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
DATES = [re.compile(x) for x in (_YEAR, f"{_YEAR}[-/.]?{_MONTH}", f"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}", f"{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}")]
DATE_COST, WALK_COST, CAPITALS_COST, LEET_COST = 4.3, 1.5, 0.5, 0.5
_NEXT = {(a, b) for walk in WALKS for x, y in zip(walk, walk[1:]) for a, b in ((x, y), (y, x))}

Ranks = dict[str, float]


def ranked(words: Iterable[str]) -> Ranks:
    """The price of each word: the logarithm of its rank among the given words, or of its place in WORDS if that is less."""
    price = {w: math.log10(k + 2) for k, w in enumerate(words)}
    for k, w in enumerate(WORDS):
        price[w] = min(price.get(w, math.inf), math.log10(k + 2))
    return price


def corpus_words(docs: DataFrame, text: str = "text", n: int = WORD_LIST, docs_at_least: int = WORD_DOCS) -> list[str]:
    """The n words that most documents have outside credential contexts, most widely used first."""
    least, most = WORD_LETTERS
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"(?i){_CONTEXT}", " ")
    words = F.array_distinct(F.split(F.lower(plain), r"[^\p{L}]+"))
    each = docs.select(F.explode(words).alias("w")).filter(F.length("w").between(least, most))
    counted = materialise(each.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= docs_at_least).withColumn("level", F.floor(16 * F.log2("n")).cast("int")))
    # Sizes of the levels first (some hundreds), so that no partition sends words that cannot be among the n.
    left, level = n, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        left, level = left - r["words"], r["level"]
        if left <= 0:
            break
    return [r["w"] for r in counted.filter(F.col("level") >= level).orderBy(F.desc("n"), "w").limit(n).collect()]  # a list of bounded size


def _single(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str, ranks: Ranks, limit: float = MAX_COST) -> float:
    """log10 of the guesses that the cheapest cut of the value needs, or limit if that is less.

    Parts: one character; a word, dearer with capitals or look-alikes; a date; 3 to REACH neighbours
    on the keyboard or alphabet, or all in a row; 2 to 8 characters, or one character thrice, said again and again,
    REACH characters at most or as often as they follow.  More than REACH characters away from both
    ends of what says itself again, no repeat starts: the one from its start says more for less.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    longest = WORD_LETTERS[1]
    walk_end = 0  # where the walk ends that i is on
    starts, ends = [0] * 9, [0] * 9  # for each period, the stretch that says itself again
    far: dict[int, float] = {}  # ends that parts longer than REACH have reached
    for i in range(n):
        here = best[i]
        if here < limit:
            # Brute force, one character at a time.
            best[i + 1] = min(best[i + 1], here + _single(value[i]))
            for j in range(i + WORD_LETTERS[0], min(n, i + longest) + 1):
                word, seen = low[i:j], value[i:j]
                price = ranks.get(word)
                if price is not None:
                    best[j] = min(best[j], here + price + (seen != word) * CAPITALS_COST)
                if (form := plain[i:j]) != word and (price := ranks.get(form)) is not None:
                    best[j] = min(best[j], here + price + LEET_COST + (seen != word) * CAPITALS_COST)
            for date in DATES:
                if (m := date.match(value, i)) is not None:
                    best[m.end()] = min(best[m.end()], here + DATE_COST)
            if walk_end <= i:
                walk_end = i + 1
                while walk_end < n and (low[walk_end - 1], low[walk_end]) in _NEXT:
                    walk_end += 1
            if walk_end - i >= 3:
                for j in range(i + 3, min(walk_end, i + REACH) + 1):
                    best[j] = min(best[j], here + WALK_COST + math.log10(j - i))
                if walk_end > i + REACH:
                    far[walk_end] = best[walk_end] = min(best[walk_end], here + WALK_COST + math.log10(walk_end - i))
            block = 0.0
            for size in range(1, 9):
                if i + size > n:
                    break
                block += _single(value[i + size - 1])
                if ends[size] < i + size:
                    starts[size], ends[size] = i, i + size
                    while ends[size] < n and value[ends[size]] == value[ends[size] - size]:
                        ends[size] += 1
                times, least = (ends[size] - i) // size, 2 if size > 1 else 3
                if times >= least and (i - starts[size] <= REACH or ends[size] - i <= REACH):
                    for k in range(least, min(times, REACH // size) + 1):
                        best[i + k * size] = min(best[i + k * size], here + block + math.log10(k))
                    if times * size > REACH:
                        end = i + times * size
                        far[end] = best[end] = min(best[end], here + block + math.log10(times))
        # No cut goes past this place for less than the limit: all that a part from before has reached is dearer.
        elif min(best[i + 1 : i + 1 + REACH], default=limit) >= limit and all(x >= limit for j, x in far.items() if j > i):
            return limit
    return min(best[n], limit)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, rank of the kind, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credentials(text: str, base: list[tuple[int, int, int]], ranks: Ranks) -> list[tuple[int, int, float, bool]]:
    """Start, end and guess cost of every value in a credential context, and whether a base assignment covers it."""
    covered = [(s, e) for s, kind, e in base if kind == 0]
    found = {m.span(1): True for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN}
    k = 0
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".!?)":
            end -= 1
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if end - start >= 8 and not (k < len(covered) and covered[k][0] <= start):
            found[start, end] = False
    return [(s, e, guess_cost(text[s:e], ranks), by_base) for (s, e), by_base in sorted(found.items())]


def guessed_spans(found: list[tuple[int, int, float, bool]], min_cost: float = MIN_COST) -> list[tuple[int, int, int]]:
    """Spans of the values that no base assignment covers and no cheap cut explains."""
    return [(s, 3, e) for s, e, cost, by_base in found if not by_base and cost >= min_cost]


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_cost: float = MIN_COST, words: list[str] | None = None) -> DataFrame:
    """Per document the counts, the digest of the base spans, all spans, and ``costs``: start:end:cost of each credential value.

    words, in order of rank, stand for the corpus's own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranked(corpus_words(docs, text) if words is None else words))

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            rows = []
            for value in batch.column(1):
                t = value.as_py() or ""
                base = base_spans(t)
                count = [0, 0, 0]
                for _, k, _ in base:
                    count[k] += 1
                found = credentials(t, base, ranks)
                costs = ",".join(f"{s}:{e}:{cost:.2f}" for s, e, cost, _ in found)
                rows.append((*count, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(sorted(base + guessed_spans(found, min_cost))), costs))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "costs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, costs string")


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "<secret>", words: list[str] | None = None) -> DataFrame:
    """docs with every span of the text replaced by the mask; all columns stay, n_chars follows the text if there is one."""
    at = docs.columns.index(text)
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(ranked(corpus_words(docs, text) if words is None else words))

    def hide(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        out, seen = [], 0
        for start, _, end in sorted(base + guessed_spans(credentials(t, base, shared.value))):
            if end > seen:
                if start >= seen:
                    out += [t[seen:start], mask]
                seen = end
        return "".join([*out, t[seen:]])

    @giving_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            before = columns[at]
            texts = [hide(x.as_py()) for x in before]
            columns[at] = pa.array(texts, before.type)
            if length_at is not None:
                columns[length_at] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[length_at].to_pylist(), strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
