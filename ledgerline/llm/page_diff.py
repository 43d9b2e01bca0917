"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path.  Neighbouring pages that are copies of each other form a
run; every page is compared with the nearest page of another run on either side, however far
that is.  Their text lines (one per block, those of menus and footers too) are aligned by a
longest common subsequence, and lines in common are template and go.

Markup breaks ties.  A template line that only one page has is shared with nobody: lines in
elements that are navigation, header, footer, sidebar, advert, notice, form or reader comments
by their name, role or class go as well.  A line inside an article or main element stays though a
neighbour repeats it, since passages of articles are quoted; there only elements and whole names
that leave no doubt mark (``INSIDE``), and the article's own header is its text.

Two pages are copies if the lines in common are COPY_SHARE of the content of both; content is
what stands in article or main elements, or in no marked part where there are none.

Only line hashes travel to the comparison, once, ordered by range: a host with a third of all
pages is spread over as many tasks as any other rows, and tasks hold one run's pages at a time,
HELD bytes of them at most; what is held longer, or reaches over the edge of a partition, is
compared in a second, small step.  Only four pages a partition reach the driver.

Defined cases: null or empty html gives an empty text; a page without a URL or host is
compared with none; repeated pages get equal rows; an empty table gives no rows; other
columns are not read; unclosed tags, comments and declarations reach to the end of the page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import giving_back, materialise

#: Two pages that share so much of their content are copies.
COPY_SHARE = 0.8
#: Bytes of line hashes of one run that a task holds while it waits for the next run.
HELD = 16 << 20
PLAIN, ARTICLE, MARKED = 0, 1, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|title|textarea|select)\b[^>]*(?:>.*?(?:</(?P=raw)\s*+(?:>|$)|$)|$)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+)/?>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden|aria-hidden\s*=\s*["']?true)(?=[\s/>"']|$)""", re.IGNORECASE)

# Names of HTML elements, and names that pages give to their parts: the latter are this operator's own choice.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Parts by the whole of a class or id, or by its first or last word ("ad-slot", "main-nav").
PARTS = frozenset("ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent newsletter pagination comments".split())
#: Parts by the whole of a class or id alone.
WHOLE = frozenset("header notice notification alert popup modal overlay subscribe signup social share sharing comment disqus respond reply replies related recommended pager login search toolbar copyright".split())
#: Parts inside an article, by the whole of a class or id: only what is no text of an article whatever its subject.
INSIDE = frozenset("ad ads ad-slot ad-box ad-unit advert adverts advertisement sponsored promo newsletter newsletter-signup signup-form comments comment-list comment-form disqus_thread related-articles related-posts share-buttons social-share cookie-banner cookie-notice".split())
#: Elements that are part of an article's text when they stand inside it.
KEPT_INSIDE = frozenset("header fieldset".split())
CLOSES_P = BLOCKS - {"body", "html"}


def _named_part(attrs: str, inside: bool = False) -> bool:
    """Whether a class, id or role says that an element is no content; inside an article only a whole name that leaves no doubt does."""
    for m in NAMES.finditer(attrs):
        if m[5]:
            return True
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        for name in value.split():
            if inside:
                if name in INSIDE:
                    return True
                continue
            words = name.replace("_", "-").split("-")
            if name in WHOLE or words[0] in PARTS or words[-1] in PARTS:
                return True
    return False


def lines(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page in order, each with PLAIN, ARTICLE or MARKED."""
    found: list[tuple[str, int]] = []
    plain: list[str] = []
    marked: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, each with what it makes of its text
    where: dict[str, list[int]] = {}  # places of open elements by name, of blocks, and of marked ones
    blocks: list[int] = []
    dropped: list[int] = []
    article = 0
    seen_article = False
    at = 0
    page = page or ""

    def flush() -> None:
        for parts, kind in ((plain, ARTICLE if article else PLAIN), (marked, MARKED)):
            if parts:
                text = " ".join(html_lib.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    found.append((text, kind))

    def close(depth: int) -> None:
        nonlocal article
        while len(stack) > depth:
            name, what = stack.pop()
            where[name].pop()
            if name in BLOCKS:
                blocks.pop()
            if what == MARKED:
                dropped.pop()
            article -= what == ARTICLE

    for m in TOKEN.finditer(page):
        if m.start() > at:
            (marked if dropped else plain).append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"]:
                (marked if dropped else plain).append(" ")
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag in CELLS:
            (marked if dropped else plain).append(" ")
        if m["end"] or m["end2"]:
            # An inline end tag does not reach beyond the block it stands in.
            if where.get(tag) and (block or not blocks or where[tag][-1] > blocks[-1]):
                close(where[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and where.get("p") and where["p"][-1] == blocks[-1]:
            close(where["p"][-1])
        what = PLAIN
        attrs = m["attrs"] or ""
        if tag in ("article", "main"):
            if dropped and not seen_article:
                close(dropped[0])
            what = MARKED if tag == "article" and seen_article and _named_part(attrs, article > 0) else ARTICLE
            seen_article = True
        elif (tag in DROPPED and not (article and tag in KEPT_INSIDE)) or (len(attrs) > 4 and tag not in ("body", "html") and _named_part(attrs, article > 0)):
            what = MARKED
        where.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        if what == MARKED:
            dropped.append(len(stack))
        article += what == ARTICLE
        stack.append((tag, what))
    if at < len(page):
        (marked if dropped else plain).append(page[at:])
    flush()
    return found


def line_codes(found: list[tuple[str, int]]) -> tuple[list[int], list[int]]:
    """The hash of each line, and four times its length plus its kind."""
    import xxhash

    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in found], [4 * len(t) + kind for t, kind in found]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a and b, by bit-parallel columns."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    in_b = set(b[head : len(b) - tail])
    # Lines that only one side has cannot be in common.
    xs = [i for i in range(head, len(a) - tail) if a[i] in in_b]
    places: dict[int, int] = {}
    for k, i in enumerate(xs):
        places[a[i]] = places.get(a[i], 0) | 1 << k
    ys = [j for j in range(head, len(b) - tail) if b[j] in places]
    if not ys:
        return out
    full = (1 << len(xs)) - 1
    rows, v = [], full
    for j in ys:
        u = v & places[b[j]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # Zeros of a row are where its length grows; walk back from the last row.
    i, j = len(xs) - 1, len(ys) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j > 0 and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((xs[i], ys[j]))
            i -= 1
            j -= 1
    return out


Page = tuple[int, int, str, list[int], list[int]]  # key, tag, host, hashes, codes


def _content(codes: list[int]) -> int:
    """Which kind of line is a page's content."""
    return ARTICLE if any(c & 3 == ARTICLE for c in codes) else PLAIN


def copies(p: Page, q: Page) -> bool:
    """Whether the lines in common are most of the content of both."""
    if p[3] == q[3]:
        return True
    a, b = _content(p[4]), _content(q[4])
    size = max(sum(c >> 2 for c in p[4] if c & 3 == a), sum(c >> 2 for c in q[4] if c & 3 == b))
    return sum(p[4][i] >> 2 for i, j in common(p[3], q[3]) if p[4][i] & 3 == a and q[4][j] & 3 == b) >= COPY_SHARE * size


def shared_lines(p: Page, q: Page | None) -> list[int]:
    """Places of the lines of p that q, a page of another run, has in common with it and that stand in no article."""
    if q is None or q[2] != p[2] or not p[2] or copies(p, q):
        return []
    return [i for i, _ in common(p[3], q[3]) if p[4][i] & 3 != ARTICLE]


FOUND = "part int, run long, what string, key long, tag int, host string, hashes array<long>, codes array<int>, gone array<int>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's pages in URL order: lines that go, pages still to compare, and the pages next to each run and to the partition's edges.

    what: done (gone is complete), open (compared with the run before; the page after comes later), first and last (pages of
    the partition), inner_first and inner_last (first page after the first run, last page before the last one), next (page after a run).
    """
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    size = 0

    def give(what: str, run: int, page: Page, gone: list[int] | None, whole: bool) -> None:
        rows.append((part, run, what, page[0], page[1], page[2], page[3] if whole else None, page[4] if whole else None, gone))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = [x.split()[0] for x in FOUND.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return made

    run, before, last = 0, None, None
    held: list[tuple[Page, list[int]]] = []
    opened = False
    for b in batches:
        for key, tag, host, hashes, codes in zip(*(b.column(c).to_pylist() for c in ("key", "tag", "host", "hashes", "codes")), strict=True):
            page = (key, tag, host, hashes, codes)
            if last is None:
                give("first", run, page, None, True)
            elif last[2] != host or not copies(last, page):
                if run == 0:
                    give("inner_first", run, page, None, True)
                for p, gone in held:
                    if run == 0:
                        give("open", run, p, gone, True)
                    else:
                        give("done", run, p, sorted({*gone, *shared_lines(p, page)}), False)
                if opened:
                    give("next", run, page, None, True)
                held, size, opened = [], 0, False
                before, run = last, run + 1
            held.append((page, shared_lines(page, before)))
            size += 12 * len(hashes) + 64
            if size > HELD:
                for p, gone in held:
                    give("open", run, p, gone, True)
                held, size, opened = [], 0, True
            last = page
            if len(rows) >= 1000:
                yield batch()
    for p, gone in held:
        give("open", run, p, gone, True)
    if last is not None:
        give("last", run, last, None, True)
        if before is not None:
            give("inner_last", run, before, None, True)
    if rows:
        yield batch()


def _edges(rows) -> dict[int, tuple[Page | None, Page | None]]:
    """For each partition the nearest page of another run before its first page and after its last one."""
    page = lambda r: (r["key"], r["tag"], r["host"], r["hashes"], r["codes"])
    at: dict[int, dict[str, Page]] = {}
    for r in rows:
        at.setdefault(r["part"], {})[r["what"]] = page(r)
    order = sorted(at)

    def nearest(parts: list[int], own: Page, outer: str, inner: str) -> Page | None:
        for k in parts:
            for name in (outer, inner):
                q = at[k].get(name)
                if q is not None and q[2] != own[2]:
                    return None
                if q is not None and not copies(own, q):
                    return q
        return None

    return {k: (nearest(order[:i][::-1], at[k]["first"], "last", "inner_last"), nearest(order[i + 1 :], at[k]["last"], "first", "inner_first")) for i, k in enumerate(order)}


def _gone(pages: DataFrame) -> DataFrame:
    """key, tag and the places of the shared lines, for pages that have any."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @giving_back
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [line_codes(lines(x.as_py())) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([c[0] for c in coded], pa.list_(pa.int64())), pa.array([c[1] for c in coded], pa.list_(pa.int32()))], names=["key", "tag", "host", "path", "hashes", "codes"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit(""))
    # Stored before the ranges are sampled: the pages are parsed once for the comparison.
    parsed = materialise(pages.select("key", "tag", host.alias("host"), path.alias("path"), "html").mapInArrow(parse, "key long, tag int, host string, path string, hashes array<long>, codes array<int>"))
    ordered = parsed.repartitionByRange(n, "host", "path", "key", "tag").sortWithinPartitions("host", "path", "key", "tag")
    found = materialise(ordered.mapInArrow(giving_back(_compared), FOUND))
    edges = spark.sparkContext.broadcast(_edges(found.filter(F.col("what").isin("first", "last", "inner_first", "inner_last")).collect()))  # four pages a partition

    @giving_back
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                p = (r["key"], r["tag"], r["host"], r["hashes"], r["codes"])
                gone = set(r["gone"])
                left, right = edges.value[r["part"]]
                if r["run"] == 0:
                    gone |= set(shared_lines(p, left))
                if r["next"] is not None:
                    q = r["next"]
                    gone |= set(shared_lines(p, (q["key"], q["tag"], q["host"], q["hashes"], q["codes"])))
                else:
                    gone |= set(shared_lines(p, right))
                out.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")), b.column(b.schema.get_field_index("tag")), pa.array(out, pa.list_(pa.int32()))], names=["key", "tag", "gone"])

    after = found.filter(F.col("what").isin("next", "inner_first")).select("part", "run", F.struct("key", "tag", "host", "hashes", "codes").alias("next")).dropDuplicates(["part", "run"])
    late = found.filter("what = 'open'").join(after, ["part", "run"], "left").select("part", "run", "key", "tag", "host", "hashes", "codes", "gone", "next").mapInArrow(finish, "key long, tag int, gone array<int>")
    both = found.filter("what = 'done'").select("key", "tag", "gone").union(late).filter("size(gone) > 0")
    # Equal rows stand side by side, so that any one of them has seen the run's nearest pages.
    return both.groupBy("key", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and of the page's lines the number shared with its nearest pages (n_shared) and gone by markup alone (n_marked)."""
    kind = pages.schema[page_id].dataType.simpleString()
    columns = (F.col(page_id), F.col(url), F.col(html))
    # A row is known by 96 bits of two independent hashes of all it has.
    p = pages.select(F.xxhash64(*columns).alias("key"), F.hash(*columns, F.lit("row")).alias("tag"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared, by_mark = [], [], []
            for page, gone in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                skip = set(gone or ())
                found = lines(page.as_py())
                texts.append("\n".join(t for k, (t, what) in enumerate(found) if what != MARKED and k not in skip))
                shared.append(len(skip))
                by_mark.append(sum(what == MARKED and k not in skip for k, (_, what) in enumerate(found)))
            made = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], shared, by_mark))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])

    both = p.join(_gone(p), ["key", "tag"], "left").select("page_id", "url", "html", "gone")
    return both.mapInArrow(cut, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_marked long")


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
