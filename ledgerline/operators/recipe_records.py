"""Recipes applied to payloads as a whole: five modes, iterators, field sources, typed records.

Recipes are few and are sent to the payloads; one pass over these gives the records of each, or one
row with the error, so that a payload is neither shuffled nor copied for each record.  To probe
only says whether the recipe hits anything.  Each mode finds its matches in its own way: JSON by
built-in functions before the pass; markup, CSV cells, regular expressions and tables of page text
in a branch of ``_items`` each.  A match meets every binding, and an error in any of them fails the
payload.  ``ExtractRecords`` is the same for SQL, a table function in a lateral join.
"""

from __future__ import annotations

import copy
import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.python_udfs import canonical, number
from .extraction import ERROR_CHARS, RECORD_CAP, SCALAR_BYTES, Page, _json, cell, excerpt, first_json, is_selector, spot_value

# Content paths that hold strings, by record type.
_MAGNITUDE = ("magnitude.metric", "magnitude.unit", "magnitude.currency", "magnitude.period")
STRING_PATHS = {
    "observation": ("metric", "unit", "currency", "period"),
    "event": ("event_type", "headline", "direction", *_MAGNITUDE),
    "relation": ("kind", "from", "to", *_MAGNITUDE),
    "entity": ("entity_id", "kind", "canonical_name"),
}
# Content fields that a record of each type needs, with the types they may have.
NEEDED = {
    "observation": {"metric": str, "value": (int, float), "unit": str, "period": str},
    "event": {"event_type": str, "headline": str},
    "relation": {"kind": str, "from": str, "to": str},
    "entity": {"entity_id": str, "kind": str, "canonical_name": str},
}
KEY_CHARS = 200
_ENTITY_ID = re.compile(r"[^\s\x00-\x1f\x7f-\x9f]+")
MODES = ("json_path", "css_select", "csv_cell", "regex_capture", "pdf_table")

#: csv_cell: path is the column, filter_column and filter_value pick the row.  regex_capture: path
#: is the pattern, grp the group.  pdf_table: spot is page from 1, then table, row and column from 0;
#: the payload is the text of the pages, one after another with form feeds between them.
RECIPE = """recipe_id string, source_id string, version int, source_url string, mode string, path string, attribute string, iterator_mode string, iterator_path string,
  inner array<struct<path:string,selector:string,attribute:string>>, topics array<string>, plan string,
  bindings array<struct<record_type:string,dedup_field:string,fields:array<struct<path:string,source:string,value:string>>>>,
  grp int, filter_column string, filter_value string, spot array<int>"""
_USED = ("recipe_id", "mode", "path", "attribute", "iterator_mode", "iterator_path", "inner", "plan", "bindings", "grp", "filter_column", "filter_value", "spot")


def walked(root: object, pointer: str) -> object:
    """What a dotted pointer leads to: numbers are places in arrays, all else names in objects; null if it leads nowhere."""
    for segment in pointer.split("."):
        if isinstance(root, dict):
            root = root.get(segment)
        elif isinstance(root, list) and segment.isdigit() and int(segment) < len(root):
            root = root[int(segment)]
        else:
            return None
    return root


def scalar(text: str | None) -> object:
    """A float if the text is one as it stands or as people write it, else the trimmed text."""
    t = (text or "").strip()
    n = number(t)
    return t if n is None else n


def assembled(record_type: str, fields: list[tuple[str, str, str | None]], plan: str | None) -> tuple[str | None, str | None]:
    """Canonical JSON of a record's content from (path, source, value), or why there is none.

    Values are texts for extracted and inner sources, JSON for literals, and pointers into the plan.
    """
    if record_type not in STRING_PATHS:
        return None, f"{record_type} is not producible from a recipe"
    content: dict = {}
    for path, source, value in fields:
        if value is None:
            return None, f"{source} {path} resolved to nothing"
        got = scalar(value) if source in ("extracted", "inner") else walked(_parsed(plan), value) if source == "from_plan" else _parsed(value)
        if got is None and source == "from_plan":
            return None, f"from_plan pointer {value} resolved to nothing"
        if isinstance(got, (dict, list)):
            got = copy.deepcopy(got)  # what is parsed once is shared
        if path in STRING_PATHS[record_type] and isinstance(got, (int, float)) and not isinstance(got, bool):
            got = canonical(got)
        *outer, last = path.split(".")
        at = content
        for segment in outer:
            at = at.setdefault(segment, {})
            if not isinstance(at, dict):
                return None, f"path segment {segment} expected an object"
        at[last] = got
    for name, kinds in NEEDED[record_type].items():
        got = content.get(name)
        if not isinstance(got, kinds) or isinstance(got, bool):
            return None, f"{record_type} content: missing or wrong {name}"
    if record_type == "entity" and (len(content["entity_id"].encode()) > 128 or not _ENTITY_ID.fullmatch(content["entity_id"])):
        return None, "invalid entity_id"
    return canonical(content), None


@functools.lru_cache(maxsize=4096)
def _parsed(text: str | None) -> object:
    return json.loads(text or "null")


@functools.lru_cache(maxsize=1024)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:
        return None


class _Failed(Exception):
    """Why a payload gives no records."""


def _shortened(text: str) -> str:
    head, tail = ERROR_CHARS * 2 // 3, ERROR_CHARS // 3
    return text if len(text) <= ERROR_CHARS else f"{text[:head]}…{text[-tail:]}"


def _bounded(value: str | None) -> str:
    """A match that is there, not empty and within the scalar bound."""
    if not value:
        raise _Failed("no match")
    if len(value.encode()) > SCALAR_BYTES:
        raise _Failed("value too long")
    return value


def _css_items(payload: str, r: dict) -> list[tuple[str | None, dict]]:
    """The main value and the inner ones of each element, looked for within it alone."""
    for selector in filter(None, (r["iterator_path"], r["path"], *[x["selector"] for x in r["inner"] or ()])):
        if not is_selector(selector):
            raise _Failed(f"selector not supported: {selector}")
    page = Page(payload)
    first = lambda selector, attribute, scope: next(filter(None, (page.value(e, attribute) for e in page.selected(selector, scope))), None)
    inner = lambda scope: {s["path"]: first(s["selector"], s["attribute"], scope) for s in r["inner"] or ()}
    if r["iterator_mode"]:
        return [(first(r["path"], r["attribute"], e), inner(e)) for e in page.selected(r["iterator_path"])]
    found = page.selected(r["path"])
    return [(page.value(found[0], r["attribute"]), inner(found[0]))] if found else []


def _scalar_item(payload: str, r: dict) -> list[tuple[str | None, dict]]:
    """The one value of a mode without iterators and inner fields."""
    if r["inner"]:
        raise _Failed(f"inner fields not implemented: {r['mode']}")
    if r["mode"] == "csv_cell":
        value, error = cell(payload, r["path"], r["filter_column"], r["filter_value"])
    elif r["mode"] == "pdf_table":
        value, error = spot_value(payload.split("\f"), r["spot"])
    else:
        pattern, group = _compiled(r["path"]), 1 if r["grp"] is None else r["grp"]
        hit = pattern.search(payload) if pattern else None
        error = "pattern does not compile" if pattern is None else "no match" if hit is None else None if group <= pattern.groups else "no such group"
        value = None if error else hit[group]
    if error:
        raise _Failed(error)
    return [(value, {})]


class _Found:
    """Matches of a JSON recipe that built-in functions have found: how many, and those that are spelled out."""

    def __init__(self, n: int, items: list):
        self.n, self.items = n, [(x["main"], x["inner"] or {}) for x in items]

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[tuple[str | None, dict]]:
        return iter(self.items)


def _items(payload: str | None, r: dict, json_items: _Found | None) -> list[tuple[str | None, dict]] | _Found:
    mode, iterator = r["mode"], r["iterator_mode"]
    if mode not in MODES:
        raise _Failed(f"unknown mode: {mode}")
    if iterator and not (iterator == mode and mode in ("json_path", "css_select")):
        raise _Failed(f"iterator not implemented: {iterator} x {mode}")
    if mode == "json_path":
        if json_items is None:
            raise _Failed("not JSON")
        items = json_items
    else:
        items = (_css_items if mode == "css_select" else _scalar_item)(payload or "", r)
    if not items:
        raise _Failed("no match")
    return items


def _key(recipe_id: str, binding: dict, fields: list[tuple[str, str, str | None]]) -> str:
    """What a record of an iterator is known by."""
    if binding["dedup_field"] is None:
        raise _Failed("iterator recipe without a dedup field")
    _, source, value = next((f for f in fields if f[0] == binding["dedup_field"]), (None, None, None))
    if source is None:
        raise _Failed("dedup field is no field of the binding")
    if source == "from_plan":
        raise _Failed("dedup field is constant across records")
    if source == "literal" and isinstance(_parsed(value), str):
        value = _parsed(value)
    return f"{recipe_id}:{(value or '')[:KEY_CHARS]}"


def records(payload: str | None, r: dict, json_items: _Found | None) -> Iterator[tuple]:
    """item, binding, record_type, dedup_key, content and value of all records; _Failed if there is an error anywhere."""
    items = _items(payload, r, json_items)
    if len(items) > RECORD_CAP:
        raise _Failed("too many matches")
    for i, (main, inner) in enumerate(items):
        main = _bounded(main)
        for b, binding in enumerate(r["bindings"]):
            fields = [(f["path"], f["source"], main if f["source"] == "extracted" else inner.get(f["path"]) if f["source"] == "inner" else f["value"]) for f in binding["fields"]]
            key = _key(r["recipe_id"], binding, fields) if r["iterator_mode"] else None
            content, error = assembled(binding["record_type"], fields, r["plan"])
            if error:
                raise _Failed(error)
            yield i, b, binding["record_type"], key, content, main


_RECORD = T.StructType().add("item", "integer").add("binding", "integer").add("record_type", "string").add("dedup_key", "string").add("content", "string").add("value", "string").add("error", "string")
_PROBE = T.StructType().add("n_items", "integer").add("ok", "boolean")


@F.udtf
class ExtractRecords:
    """extract_records(payload, recipe, json_items, probe): the records of a payload, or with probe whether there are any matches."""

    @staticmethod
    def analyze(payload: AnalyzeArgument, recipe: AnalyzeArgument, json_items: AnalyzeArgument, probe: AnalyzeArgument) -> AnalyzeResult:
        # A recipe comes as a struct, or as the JSON of one, which is read once and not for each row.
        if not isinstance(recipe.dataType, T.StringType):
            known = set(recipe.dataType.fieldNames()) if isinstance(recipe.dataType, T.StructType) else set()
            if missing := sorted(set(_USED) - known):
                raise Exception(f"the recipe lacks {', '.join(missing)}")
        if not probe.isConstantExpression:
            raise Exception("probe must be a constant")
        return AnalyzeResult(_PROBE if probe.value else _RECORD)

    def eval(self, payload: str, recipe: T.Row | str, json_items: list | str, probe: bool) -> Iterator[tuple]:
        yield from _answers(payload, recipe, json_items, probe)


def _answers(payload: str | None, recipe: T.Row | str, json_items: list | str | None, probe: bool) -> list[tuple]:
    """The rows of a payload: its records, or one with the error; with probe, whether there are any matches."""
    recipe = _parsed(recipe) if isinstance(recipe, str) else recipe
    if isinstance(json_items, str):
        found = json.loads(json_items)
        json_items = _Found(found["n"], found["items"] or ())
    elif json_items is not None:
        json_items = _Found(len(json_items), json_items)
    try:
        if probe:
            items = _items(payload, recipe, json_items)
            return [(len(items), bool(recipe["iterator_mode"]) or any(m for m, _ in items))]
        return [(*x, None) for x in records(payload, recipe, json_items)]
    except _Failed as e:
        return [(0, False) if probe else (None, None, None, None, None, None, _shortened(str(e)))]


def _json_items(payload: Column, probe: bool) -> tuple[Column, Column]:
    """How many matches a JSON recipe has, null for other modes and for payloads that are no JSON; and the matches themselves, with inner values looked for within each.

    Matches are spelled out only where they are asked for: not to probe an iterator, nor of a payload that has too many.
    """
    path = F.col("path")
    listed = _json(payload, F.col("iterator_path"))
    inner = lambda node: F.map_from_arrays(F.transform("inner", lambda s: s["path"]), F.transform("inner", lambda s: F.call_function("get_json_object", node, s["selector"])))
    within = lambda node: F.struct(F.when(path == "$", node).otherwise(first_json(node, path)).alias("main"), inner(node).alias("inner"))
    scope = first_json(payload, path)
    alone, iterated = F.col("iterator_mode").isNull(), F.col("iterator_mode").isNotNull()
    sound = (F.col("mode") == "json_path") & _json(payload, F.lit("$")).isNotNull()
    n = F.when(sound, F.when(alone, 1).otherwise(F.coalesce(F.json_array_length(listed), F.lit(0))))
    many = F.transform(F.from_json(listed, "array<string>"), within)
    wanted = F.lit(False) if probe else iterated & F.col("_n").between(1, RECORD_CAP)
    return n, F.when(alone & F.col("_n").isNotNull(), F.array(F.struct(scope.alias("main"), inner(scope).alias("inner")))).when(wanted, many)


#: Rows in a batch that goes out: a payload may have hundreds of records.
_ROWS_OUT = 4096


def _called(payloads: DataFrame, recipes: DataFrame, keep: list[str], probe: bool) -> DataFrame:
    """The columns to keep, and the fields of each record or probe."""
    whole = {"ignoreNullFields": "false"}
    recipes = recipes.withColumn("_recipe", F.to_json(F.struct(*[F.col(c) for c in _USED]), whole))
    # Recipes are few and payloads many to each: the recipes go to the payloads, which stay where they are.
    both = payloads.join(F.broadcast(recipes), "recipe_id")
    n, items = _json_items(F.col("payload"), probe)
    both = both.withColumn("_n", n).withColumn("_json", F.to_json(F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("n"), items.alias("items"))), whole))
    # What built-in functions have found needs no payload on the other side.
    both = both.select(*keep, F.when(F.col("mode") != "json_path", F.col("payload")).alias("_text"), "_recipe", "_json")
    made = _PROBE if probe else _RECORD
    types = to_arrow_schema(made)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kept = batch.select(keep).take(pa.array(at, pa.int32()))
            return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)]], [*keep, *types.names])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_text", "_recipe", "_json")], strict=True)):
                found = _answers(*row, probe)
                rows += found
                at += [i] * len(found)
                if len(rows) >= _ROWS_OUT:
                    yield out(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield out(batch, at, rows)

    return both.mapInArrow(answered, T.StructType([*both.select(*keep).schema.fields, *made.fields]))


def recipe_path(mode: Column, path: Column, attribute: Column) -> Column:
    """How the place of a value is written, by mode."""
    spot = F.col("spot")
    csv = F.concat(F.lit("csv:"), path, F.coalesce(F.concat(F.lit("@"), "filter_column", F.lit("="), "filter_value"), F.lit("")))
    pdf = F.concat(F.lit("pdf:p"), F.get(spot, F.lit(0)), F.lit("/t"), F.get(spot, F.lit(1)), F.lit("/r"), F.get(spot, F.lit(2)), F.lit("/c"), F.get(spot, F.lit(3)))
    css = F.concat(F.lit("css:"), path, F.coalesce(F.concat(F.lit("["), attribute, F.lit("]")), F.lit("")))
    regex = F.concat(F.lit("regex:group="), F.coalesce("grp", F.lit(1)))
    return F.when(mode == "json_path", F.concat(F.lit("json:"), path)).when(mode == "css_select", css).when(mode == "csv_cell", csv).when(mode == "pdf_table", pdf).when(mode == "regex_capture", regex)


def applied(payloads: DataFrame, recipes: DataFrame) -> DataFrame:
    """Records of payloads (payload_id, recipe_id, payload) by recipes (columns of RECIPE): item, binding, record_type, dedup_key, content and envelope fields, or one row with the error.

    A payload and a recipe fail together as a whole; another recipe over the same payload does not.
    """
    outer = F.concat(F.when(F.col("iterator_mode").isNotNull(), recipe_path(F.col("iterator_mode"), F.col("iterator_path"), F.lit(None).cast("string"))), F.lit(" >> "))
    path = F.concat(F.coalesce(outer, F.lit("")), recipe_path(F.col("mode"), F.col("path"), F.col("attribute")))
    source = F.concat("source_id", F.lit("#recipe:"), "recipe_id", F.lit("@v"), "version")
    said = recipes.withColumn("_said", F.struct(source.alias("source_id"), "source_url", "topics", path.alias("selector_path")))
    made = _called(payloads, said, ["payload_id", "recipe_id", "_said"], probe=False)
    when_ok = lambda c: F.when(F.col("error").isNull(), c)
    return made.select(
        "payload_id", "recipe_id", "item", "binding", "record_type", "dedup_key", "content",
        when_ok(F.col("_said.source_id")).alias("source_id"), when_ok(F.col("_said.source_url")).alias("source_url"), when_ok(F.lit("unknown")).alias("license"),
        when_ok(F.col("_said.topics")).alias("topics"), when_ok(F.col("_said.selector_path")).alias("selector_path"), when_ok(excerpt(F.col("value"))).alias("excerpt"), "error",
    )


def probed(payloads: DataFrame, recipes: DataFrame) -> DataFrame:
    """Whether a recipe hits anything in a payload at authoring time: an iterator with any number of matches will do."""
    return _called(payloads, recipes, ["payload_id", "recipe_id"], probe=True)
