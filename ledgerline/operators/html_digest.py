"""What repeats in a page: headings, shapes of tables and lists, classes that several elements share.

One Arrow-batched pass lists the elements of a page and counts its ``tag.class`` pairs.  Rows of
elements are exploded and grouped; a digest is put together within the row of its page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import once
from .extraction import _ENDS, VOID, Reader
from .presentation import truncated

# Bounds of a digest, and the elements whose text is not seen.
HEADING_BYTES, TABLES, LISTS, CLASSES, LEAST = 1024, 50, 50, 30, 2
UNSEEN = ("script", "style", "noscript")

ELEMENT = T.StructType().add("tag", "string").add("element_id", "string").add("classes", "string").add("rows", "integer").add("cols", "integer").add("text", "string")
PAGE = T.StructType().add("elements", T.ArrayType(ELEMENT)).add("visible", "string").add("repeated", T.ArrayType(T.StructType().add("n", "long").add("selector", "string")))
#: Pages in a batch that goes out.
_PAGES = 64
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


class _Lister(Reader):
    """Elements in document order with what stands in them: rows and first-row cells of tables, items of lists, text of headings."""

    def __init__(self) -> None:
        super().__init__()
        self.elements: list[dict] = []
        self.open: list[tuple[str, dict]] = []
        self.visible: list[str] = []
        self.unseen = 0

    def _close(self, at: int) -> None:
        self.unseen -= sum(tag in UNSEEN for tag, _ in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes, bounds = _ENDS.get(tag, ((), ()))
        last = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in bounds:
                break
            if self.open[k][0] in closes:
                last = k
        if last is not None:
            self._close(last)
        found = {k: self.plain(v) for k, v in attrs}
        element = {"tag": tag, "element_id": found.get("id"), "classes": found.get("class"), "rows": 0, "cols": 0, "text": [] if tag in ("title", "h1") else None}
        for name, outer in self.open:
            if name == "table":
                if tag == "tr":
                    outer["rows"] += 1
                    outer.setdefault("first", element)
                elif tag in ("td", "th") and any(o is outer.get("first") for _, o in self.open):
                    outer["cols"] += 1
            elif name in ("ul", "ol") and tag == "li":
                outer["rows"] += 1
        self.elements.append(element)
        if tag not in VOID:
            self.open.append((tag, element))
            self.unseen += tag in UNSEEN

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        data = self.plain(data)
        for _, element in self.open:
            if element["text"] is not None:
                element["text"].append(data)
        if not self.unseen and not any(tag in ("title", "head") for tag, _ in self.open):
            self.visible.append(data)


def _page(page: str | None) -> dict:
    lister = _Lister()
    lister.read(page)
    blank = lambda t: " ".join(t.split())
    fields = ("tag", "element_id", "classes", "rows", "cols")
    elements = [{f: e[f] for f in fields} | {"text": blank("".join(e["text"])) if e["text"] is not None else None} for e in lister.elements]
    pairs = Counter(f"{e['tag']}.{c}" for e in elements for c in _BLANKS.split(e["classes"] or "") if c)
    repeated = sorted((-n, selector) for selector, n in pairs.items() if n >= LEAST)
    return {"elements": elements, "visible": blank(" ".join(lister.visible)), "repeated": [{"n": -n, "selector": selector} for n, selector in repeated]}


def _listed(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key and what stands in each page; few pages are held at a time, whatever comes in a batch."""
    kind = to_arrow_schema(PAGE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PAGES):
                part = batch.slice(lo, _PAGES)
                found = [_page(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([f[name] for f in found], kind.field(name).type) for name in kind.names]], [key, *kind.names])

    both = pages.select(key, page)
    return both.mapInArrow(read, T.StructType([both.schema[key], *PAGE.fields]))


def page_elements(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, place and the fields of each element, in document order."""
    return _listed(pages, key, page).select(key, F.posexplode("elements").alias("place", "e")).select(key, "place", "e.*")


def headings(elements: DataFrame, key: str) -> DataFrame:
    """The first title and all first headings that are not blank, shortened."""
    first = F.row_number().over(Window.partitionBy(key, "tag").orderBy("place"))
    kept = elements.filter("tag IN ('title', 'h1')").withColumn("turn", first).filter("(tag = 'h1' OR turn = 1) AND text <> ''")
    return kept.select(key, "tag", F.col("turn").cast("long").alias("turn"), truncated(F.col("text"), HEADING_BYTES).alias("text"))


def repeated_classes(elements: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """selector (``tag.class``), how many elements it selects, and its place: most elements first, then by name."""
    each = elements.select(key, "tag", F.explode(F.split(F.trim(F.regexp_replace("classes", r"\s+", " ")), " ")).alias("class")).filter("class <> ''")
    counted = each.groupBy(key, F.concat_ws(".", "tag", "class").alias("selector")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "selector")))


def digests(pages: DataFrame, key: str, page: str, budget: int) -> DataFrame:
    """key and one text a page: headings, shapes, repeated classes, then as much of the visible text as the budget has left."""
    each = _listed(pages, key, page)
    optional = lambda name, v: F.coalesce(F.concat(F.lit(f' {name}="'), v, F.lit('"')), F.lit(""))
    sign = lambda e: F.concat(F.lit("  <"), e["tag"], optional("id", e["element_id"]), optional("class", e["classes"]), F.lit("> ("), e["rows"])
    of = lambda *tags: F.filter("elements", lambda e: e["tag"].isin(*tags))

    def section(rows: Column, title: str, cap: int, line: Callable[[Column], Column], more: str) -> Column:
        def shown(r: Column) -> Column:
            rest = F.when(F.size(r) > cap, F.concat(F.lit("\n  [... "), F.size(r) - cap, F.lit(f" more {more}truncated]"))).otherwise("")
            return F.when(F.size(r) > 0, F.concat(F.lit(title), F.array_join(F.transform(F.slice(r, 1, cap), line), "\n"), rest, F.lit("\n"))).otherwise("")

        return once(rows, shown)

    heads = section(F.filter(F.concat(F.slice(of("title"), 1, 1), of("h1")), lambda e: e["text"] != ""), "", 1 << 30, lambda e: F.concat(F.lit("<"), e["tag"], F.lit(">: "), truncated(e["text"], HEADING_BYTES)), "")
    tables = section(of("table"), "\nTables:\n", TABLES, lambda e: F.concat(sign(e), F.lit(" rows × "), e["cols"], F.lit(" cols)")), "tables ")
    lists = section(of("ul", "ol"), "\nLists:\n", LISTS, lambda e: F.concat(sign(e), F.lit(" items)")), "lists ")
    repeated = section(F.col("repeated"), "\nRepeating element classes (iterator-eligible):\n", CLASSES, lambda e: F.concat(F.lit("  "), e["selector"], F.lit(": "), e["n"], F.lit(" occurrences")), "")
    top = F.concat(F.lit("--- HTML structure ---\n"), heads, tables, lists, repeated)
    header = "\n--- Visible text (script/style excluded, truncated) ---\n"
    left = F.lit(budget) - F.octet_length("top") - len(header)
    return each.select(key, "visible", top.alias("top")).withColumn("left", left).select(key, _with_text(header).alias("digest"))


def _with_text(header: str):
    """The structure, and the visible text that its bytes leave room for."""
    visible, left = F.col("visible"), F.col("left")
    # The longest beginning in so many bytes: a character cut in two decodes to one replacement character.
    most = F.length(F.make_valid_utf8(F.substr(F.encode(visible, "UTF-8"), F.lit(1), left).cast("string")))
    whole = F.substr(visible, F.lit(1), most)
    fits = F.when(F.octet_length(whole) <= left, whole).otherwise(F.substr(visible, F.lit(1), most - 1))
    text = (
        F.when(left <= 0, F.lit("[... structure summary consumed the budget; visible text elided]\n"))
        .when(F.octet_length(visible) <= left, F.concat(visible, F.when(visible != "", "\n").otherwise("")))
        .otherwise(F.concat(fits, F.lit("\n[... visible text truncated at "), left, F.lit(" bytes; full body text was "), F.octet_length(visible), F.lit(" bytes]\n")))
    )
    return F.concat("top", F.lit(header), text)
