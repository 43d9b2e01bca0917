"""Queries of shapes in documents: nested JSON, tables, charts, repair, page structure, references; whole recipes of all modes; recent sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import html_digest as H
from ..operators import json_shapes as J
from ..operators import recipe_records as R
from ..sources import bridge as B
from ..streaming.recent import sliding_sums
from . import catalog_state as _before  # the queries before these
from .catalog import query
from .catalog_recipes import _recipes

catalog = _before.catalog

# --- A26, N17: nested JSON ------------------------------------------------------------------

_NESTED = """p AS (SELECT o_orderkey AS k, '{"customer":{"id":' || o_custkey || ',"tier":' || CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"gold"' ELSE '2' END || '},"flag":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '{"deep":[[1,2],[]]}' END
  || ',"lines":[' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{"q":' || o_orderkey || '}' ELSE '{"q":null},{"q":0.5,"t":"a \\"b\\" {["}' END || ']}' AS j FROM orders)""".replace('\\\\"', '\\"')


def _nested(spark, d):
    k = F.col("o_orderkey")
    tier = F.when(k % 3 == 0, "null").when(k % 3 == 1, '"gold"').otherwise("2")
    flag = F.when(k % 2 == 0, "true").otherwise('{"deep":[[1,2],[]]}')
    lines = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit('{"q":'), k, F.lit("}"))).otherwise('{"q":null},{"q":0.5,"t":"a \\"b\\" {["}')
    text = F.concat(F.lit('{"customer":{"id":'), "o_custkey", F.lit(',"tier":'), tier, F.lit('},"flag":'), flag, F.lit(',"lines":['), lines, F.lit("]}"))
    return B.spread(spark, d, "orders", "o_orderkey").select(k.alias("k"), text.alias("j"))


_TREE = _NESTED + r""", t AS (SELECT k, regexp_replace(fullkey, '\[[0-9]+\]', '[]', 'g') AS path, id, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN type = 'ARRAY' THEN CAST(json_array_length(value) AS BIGINT) END AS length, CASE WHEN type = 'NULL' THEN 'null' WHEN type NOT IN ('OBJECT', 'ARRAY') THEN CAST(atom AS VARCHAR) END AS sample FROM p, json_tree(p.j))"""


@query("WITH " + _TREE + " SELECT path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, count(*) AS n, min(length) AS shortest, max(length) AS longest, count(DISTINCT kind) > 1 AND NOT bool_or(kind IN ('object', 'array')) AS polymorphic, coalesce(array_to_string(list(sample ORDER BY k, id) FILTER (WHERE sample IS NOT NULL)[1:5], ' ; '), '') AS samples FROM t GROUP BY path")
def nested_paths(spark, d):
    """Every path of nested documents: kinds, array lengths, the first five samples."""
    stats = J.path_statistics(J.json_paths(_nested(spark, d), ["k"], "j"), [], ["k"])
    return stats.select("path", "kinds", "n", "shortest", "longest", "polymorphic", F.array_join("samples", " ; ").alias("samples"))


@query("WITH " + _TREE + ", s AS (SELECT k, path, min(id) AS id, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, min(length) AS lo, max(length) AS hi, count(DISTINCT kind) > 1 AND NOT bool_or(kind IN ('object', 'array')) AS poly, list(sample ORDER BY id) FILTER (WHERE sample IS NOT NULL)[1:5] AS samples FROM t GROUP BY 1, 2) SELECT k, string_agg(path || ' : ' || CASE WHEN poly THEN kinds || '   ← polymorphic; first ' || len(samples) || ' values: [' || array_to_string(list_transform(samples, lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', ') || ']' WHEN kinds = 'array' THEN 'array[' || CASE WHEN lo = hi THEN lo || '' ELSE lo || '..' || hi END || ']' ELSE kinds END, ' ; ' ORDER BY id) AS lines FROM s GROUP BY k")
def path_outlines(spark, d):
    """The lines of each document's outline, in the order of a walk through it."""
    return J.document_statistics(_nested(spark, d), ["k"], "j").select("k", F.array_join(J.path_lines(F.col("paths")), " ; ").alias("lines"))


@query("""SELECT event_id AS id, '--- JSON shape ---' || chr(10) || '$ : object' || chr(10) || '$.k : number' || chr(10) || '$.v : array[3]' || chr(10) || '$.v[] : null|number   ← polymorphic; first 3 values: ["null", "' || event_id || '", "null"]' || chr(10)
  || chr(10) || '--- First 2 elements of $.v ---' || chr(10) || '[' || chr(10) || '  null,' || chr(10) || '  ' || event_id || chr(10) || ']' || chr(10) || '--- end JSON shape ---' || chr(10) AS outline FROM events""")
def json_outlines(spark, d):
    """Whole outlines, with the first elements of the first array."""
    body = F.concat(F.lit('{"v":[null,'), "event_id", F.lit(',null],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return J.json_outlines(B.spread(spark, d, "events", "event_id").select(F.col("event_id").alias("id"), body.alias("j")), ["id"], "j")


# --- D9, D10, D11: tables and charts in documents, repair -------------------------------------

_TABLES = {
    0: ('{"meta":{"x":1,"y":2,"z":3},"rows":[{"a":1,"b":2},{"b":3}]}', "rows", "array_of_objects", 2, "b,a"),
    1: ('{"meta":{"x":1,"y":null,"z":"q"},"deep":{"m":{"p":1,"q":true}}}', "meta", "object_of_scalars", 3, "Key,Value"),
    2: ('[[{"a":1},{"a":2}],[{"b":1},{"b":2},{"b":3}],4]', "[1]", "array_of_objects", 3, "b"),
    3: ('  {"z":[{"a":1},{"a":2}],"a":[{"c":1},{"c":2}]}\n', "z", "array_of_objects", 2, "a"),
    4: ('{"top":{"rows":[{"a":1,"s":"]}"},{"a":2},{"a":3,"b', "top.rows", "array_of_objects", 2, "a,s"),
    5: ('[{"one":1,"two":2},{"one":3,"two":4}]', "$", "array_of_objects", 2, "one,two"),
    6: ('{"b":{"u":1,"v":2},"10":{"u":1,"v":2},"9":{"u":3,"v":4}}', "9", "object_of_scalars", 2, "Key,Value"),
}
_NO_TABLES = {7: "text [1]", 8: '{"a":[1,2],"b":{"c":1}}', 9: "{broken", 10: '[{},{}]'}


def _bodies(spark, d, bodies: dict[int, str]):
    k = F.col("o_orderkey")
    which = k % (max(bodies) + 1)
    body = F.coalesce(*[F.when(which == i, F.lit(b)) for i, b in bodies.items()])
    return B.table(spark, d, "orders").select(k.alias("id"), which.alias("which"), body.alias("body"))


def _cases(which: str, values: dict) -> str:
    return "CASE " + which + " " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for i, v in values.items()) + " END"


@query("SELECT * FROM (SELECT o_orderkey AS id, " + ", ".join(f"{_cases('o_orderkey % 11', {i: v[c] for i, v in _TABLES.items()})} AS {name}" for c, name in ((1, "path"), (2, "table_kind"), (3, "rows"), (4, "columns"))) + " FROM orders) WHERE path IS NOT NULL")
def table_shapes(spark, d):
    """The table to show of each document; arrays of objects come before objects of scalars, ties go to the first seen, cut documents are repaired."""
    rows = _bodies(spark, d, {i: v[0] for i, v in _TABLES.items()} | _NO_TABLES)
    return J.table_shapes(rows, ["id"], "body").withColumn("columns", F.array_join("columns", ",")).withColumn("rows", F.col("rows").cast("int"))


@query("""SELECT o_orderkey AS id, CAST(i AS INT) AS row, CASE o_orderkey % 2 WHEN 0 THEN '{"a":' || (o_orderkey + i) || ',"b":"x"}' ELSE ['{"Key":"k1","Value":' || o_orderkey || '}', '{"Key":"b","Value":null}', '{"Key":"a","Value":"q"}'][i + 1] END AS content FROM orders, (SELECT unnest([0, 1, 2]) AS i)""")
def table_rows(spark, d):
    """Rows of tables: the objects of an array, the members of an object in their order."""
    k = F.col("o_orderkey")
    item = lambda i: F.concat(F.lit('{"a":'), k + i, F.lit(',"b":"x"}'))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"list":['), F.concat_ws(",", item(0), item(1), item(2)), F.lit("]}"))).otherwise(F.concat(F.lit('{"k1":'), k, F.lit(',"b":null,"a":"q"}')))
    return J.table_rows(B.table(spark, d, "orders").select(k.alias("id"), body.alias("body")), ["id"], "body").select("id", "row", "content")


@query("""WITH s AS (SELECT * FROM (VALUES (0, 0, 'close'), (0, 1, 'price'), (0, 2, 'volume'), (0, 3, 'alpha'), (0, 4, 'beta'), (1, 0, 'rate'), (1, 1, '')) v(w, place, series))
SELECT o_orderkey AS id, place, series, CASE w WHEN 0 THEN 'S' || o_orderkey ELSE 'n' END AS label, CASE w WHEN 0 THEN 3 ELSE 2 END AS points, CAST(o_orderkey AS DOUBLE) + place AS last FROM orders JOIN s ON s.w = o_orderkey % 4""")
def chart_series(spark, d):
    """Series that can be drawn over the first timestamps of a document, by rank of their names."""
    k = F.col("o_orderkey")
    three = lambda name, i: F.concat(F.lit(f'"{name}":[0,1.5,'), k + i, F.lit("]"))
    full = F.concat(F.lit('{"alpha":"x","meta":{"name":"n","Symbol":"S'), k, F.lit('"},"t":{"Timestamp":[10,20,30],'), F.concat_ws(",", three("beta", 4), three("volume", 2), three("Price", 1)), F.lit(',"nulls":[1,null,2],"two":[1,2]},"u":{"timestamps":[1,2],'), F.concat_ws(",", three("Close", 0)), F.lit("}}"))
    # The first name without a rank is the first seen: beta comes before alpha in the document unless alpha is walked first.
    full = F.replace(full, F.lit('{"alpha":"x",'), F.concat(F.lit("{"), three("alpha", 3), F.lit(",")))
    bare = F.concat(F.lit('{"id":"i","name":"n","timestamp":[1,2],"rate":[5,'), k, F.lit('],"more":[[7,'), k + 1, F.lit("]],\"cut\":[1,2"))
    body = F.when(k % 4 == 0, full).when(k % 4 == 1, bare).when(k % 4 == 2, '{"close":[1,2]}').otherwise('{"timestamp":[1,2],"close":[1,2,3]}')
    series = J.chart_catalogs(B.spread(spark, d, "orders", "o_orderkey").select(k.alias("id"), body.alias("body")), ["id"], "body")
    return series.select("id", "place", "series", "label", F.size("timestamps").alias("points"), F.element_at("values", -1).alias("last"))


@query("SELECT user_id AS id, CAST(i AS INT) AS i, CAST(i * 10 AS DOUBLE) AS x FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 3, 6, 9, 10]) AS i)")
def chart_points(spark, d):
    """Every third of eleven points, and the last."""
    at = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: (i * 10).cast("double"))
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().select("id", at.alias("timestamps"), at.alias("values"))
    p = J.chart_points(rows, 4)
    return rows.select("id", F.explode(p).alias("p")).select("id", (F.col("p.x") / 10).cast("int").alias("i"), "p.x")


@query(None)
def recovered_documents(spark, d):
    """A document cut at every place of its text, repaired."""
    full = F.concat(F.lit('{"id":'), F.col("o_orderkey"), F.lit(',"a":[{"s":"x]}\\""},{"t":[1,2]}],"b":{"c":"d"}}'))
    cut = F.substr(full, F.lit(1), (F.col("o_orderkey") % F.length(full)).cast("int"))
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cut.alias("cut")).select("id", J.recovered(F.col("cut")).alias("body"))


# --- N16: what repeats in a page; N5, N6: references -----------------------------------------


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)\\b[^>]*?\\sclass="([^"]*)"', 1)) AS tag, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)\\b[^>]*?\\sclass="([^"]*)"', 2)) AS classes FROM (SELECT page_id, regexp_replace(html, '(?s)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g') AS html FROM pages)),
n AS (SELECT page_id, tag || '.' || class AS selector, count(*) AS n FROM (SELECT page_id, tag, unnest(regexp_split_to_array(trim(classes), '\\s+')) AS class FROM c) WHERE class <> '' GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT page_id, selector, n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n DESC, selector) AS INT) AS place FROM n""".replace("\\\\", "\\"))
def repeated_classes(spark, d):
    """Classes that several elements of a page share: what an iterator would select."""
    return H.repeated_classes(H.page_elements(B.spread(spark, d, "pages", "page_id"), "page_id", "html"), "page_id")


@query("""WITH h AS (SELECT page_id, regexp_replace(html, '(?s)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g') AS html FROM pages),
e AS (SELECT page_id, 'title' AS tag, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS text, 1 AS turn FROM h WHERE regexp_matches(html, '<title') UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), generate_subscripts(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), 1) FROM h)
SELECT page_id, tag, CAST(turn AS BIGINT) AS turn, text FROM (SELECT page_id, tag, turn, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM e) WHERE text <> ''""".replace("\\\\", "\\"))
def page_headings(spark, d):
    """Titles and first headings."""
    return H.headings(H.page_elements(B.spread(spark, d, "pages", "page_id"), "page_id", "html"), "page_id")


@query(None)
def page_digests(spark, d):
    """Structure and visible text of each page within 4,000 bytes."""
    return H.digests(B.spread(spark, d, "pages", "page_id"), "page_id", "html", 4000)


@query("""SELECT event_id AS id, chr(CAST(8192 + event_id % 1000 AS INT)) || chr(CAST(65 + event_id % 26 AS INT)) || ' &lt; &#38; <"' || chr(128512) || chr(39) || '&bogus; &#xD800; &#1114112; &toolonganame; & ;' AS text FROM events""")
def decoded_references(spark, d):
    """Named, decimal and hexadecimal references, each decoded once; what is none stays."""
    i = F.col("event_id")
    text = F.concat(F.lit("&#"), 8192 + i % 1000, F.lit(";&#x"), F.hex(65 + i % 26), F.lit("; &amp;lt; &#38;#38; &lt;&quot;&#X1F600;&#39;&bogus; &#xD800; &#1114112; &toolonganame; & ;"))
    return B.table(spark, d, "events").select(i.alias("id"), T.decoded(text).alias("text"))


@query(r"""SELECT page_id, 'It' || chr(8217) || 's A' || ' ' || trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def stripped_references(spark, d):
    """Pages that begin with numeric references."""
    return B.table(spark, d, "pages").select("page_id", T.stripped_html(F.concat(F.lit("<p>It&#8217;s &#x41;</p>"), "html")).alias("body"))


# --- X3-X5, X10, X17: whole recipes of every mode --------------------------------------------

_OBSERVED = ("observation", None, [("metric", "literal", '"output"'), ("value", "extracted", None), ("unit", "literal", '"t"'), ("period", "literal", '"annual"')])
_MODES = ("json_path", "css_select", "csv_cell", "regex_capture", "pdf_table")
_PATHS = ("json:$.v", "css:td.v[data-x]", "csv:production@country=Chile", "regex:group=1", "pdf:p2/t0/r1/c1")
_ERRORS = ("not JSON", "no match", "2 rows match", "no match", "no such cell")


def _all_modes(spark, d):
    k = F.col("o_orderkey")
    mode, bad = k % 5, k % 3 == 0
    chile = lambda n: F.concat(F.lit("Chile, "), n, F.lit("\n"))
    payloads = [
        F.when(bad, F.lit("{")).otherwise(F.concat(F.lit('{"v":"'), k, F.lit(' t"}'))), F.when(bad, F.lit("<td class=w>1")).otherwise(F.concat(F.lit('<table><tr><td>1<td class="v" data-x="'), k, F.lit('">z</table>'))),
        F.concat(F.lit("country, production\nPeru, 1\n"), chile(k), F.when(bad, chile(F.lit(7))).otherwise("")), F.when(bad, F.lit("none")).otherwise(F.concat(F.lit("Production: "), k, F.lit(" tonnes"))),
        F.concat(F.lit("one page\f"), F.when(bad, F.lit("Title\n")).otherwise(F.concat(F.lit("Title\nCountry Production\n\nChile "), k, F.lit("\nend")))),
    ]
    text = F.coalesce(*[F.when(mode == i, p) for i, p in enumerate(payloads)])
    recipes = _recipes(
        spark,
        *[{"recipe_id": str(i), "mode": m, "bindings": [_OBSERVED]} | extra for i, (m, extra) in enumerate(zip(_MODES, (
            {"path": "$.v"}, {"path": "td.v", "attribute": "data-x"}, {"path": "production", "filter_column": "country", "filter_value": "Chile"}, {"path": "Production: *([0-9]+) *tonnes", "grp": 1}, {"path": None, "spot": [2, 0, 1, 1]},
        ), strict=True))],
    )
    return R.applied(B.spread(spark, d, "orders", "o_orderkey").select(k.alias("payload_id"), mode.cast("string").alias("recipe_id"), text.alias("payload")), recipes)


@query(f"""SELECT o_orderkey AS payload_id, CASE WHEN o_orderkey % 3 <> 0 THEN '{{"metric":"output","period":"annual","unit":"t","value":' || o_orderkey || '.0}}' END AS content, CASE WHEN o_orderkey % 3 <> 0 THEN {_cases('o_orderkey % 5', dict(enumerate(_PATHS)))} END AS selector_path, CASE WHEN o_orderkey % 3 = 0 THEN {_cases('o_orderkey % 5', dict(enumerate(_ERRORS)))} END AS error FROM orders""")
def records_of_modes(spark, d):
    """One recipe of each mode: a record, or why there is none."""
    return _all_modes(spark, d).select("payload_id", "content", "selector_path", "error")


_REFUSED = {0: "iterator not implemented: json_path x csv_cell", 1: "inner fields not implemented: regex_capture", 2: "pattern does not compile", 3: "no such group", 4: "selector not supported: td:hover", 5: "unknown mode: xpath", 6: "value too long"}


@query("SELECT error, count(*) AS n FROM (SELECT " + _cases("o_orderkey % 8", _REFUSED) + " AS error FROM orders) GROUP BY 1")
def refused_recipes(spark, d):
    """Recipes that cannot work say so; a value of 2,048 bytes is within the bound, one of a byte more is not."""
    event = ("event", None, [("event_type", "literal", '"e"'), ("headline", "extracted", None)])
    recipes = _recipes(spark, *[{"recipe_id": str(i), "mode": "regex_capture", "path": "^(.*)$", "grp": 1, "bindings": [event]} | r for i, r in enumerate((
        {"mode": "csv_cell", "iterator_mode": "json_path", "iterator_path": "$.a"}, {"inner": [("headline", "x", None)]}, {"path": "(open"}, {"grp": 2}, {"mode": "css_select", "path": "td:hover"}, {"mode": "xpath"}, {}, {},
    ))])
    k = F.col("o_orderkey") % 8
    payloads = B.spread(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("payload_id"), k.cast("string").alias("recipe_id"), F.when(k == 6, F.repeat(F.lit("é"), 1025)).when(k == 7, F.repeat(F.lit("é"), 1024)).otherwise("text").alias("payload"))
    return R.applied(payloads, recipes).groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS payload_id, CAST(i AS INT) AS item, 'p' || (o_orderkey + i) || ' & <b>' AS main, CASE WHEN i = 0 THEN 'first' ELSE 'q' END AS inner_text FROM orders, (SELECT unnest([0, 1, 2]) AS i)""")
def selected_children(spark, d):
    """Selector lists, child steps and items whose end tags are left out."""
    k = F.col("o_orderkey")
    li = lambda i, extra: F.concat(F.lit("<li><b>"), F.lit(extra), F.lit("</b><a>p"), k + i, F.lit(" &amp; &lt;b&gt;</a><p>x<p>y"))
    page = F.concat(F.lit("<div class=menu><li><a>no</a></div><ul id=list>"), li(0, "first"), li(1, "q"), li(2, "q"), F.lit("</ul><dl><dt><a>never</a></dl>"))
    binding = ("event", "headline", [("event_type", "inner", None), ("headline", "extracted", None)])
    recipe = {"mode": "css_select", "iterator_mode": "css_select", "iterator_path": "ol > li, ul#list > li", "path": "a", "inner": [("event_type", "b, i", None)], "bindings": [binding]}
    rows = B.spread(spark, d, "orders", "o_orderkey").select(k.alias("payload_id"), F.lit("r").alias("recipe_id"), page.alias("payload"))
    return R.applied(rows, _recipes(spark, recipe)).select("payload_id", "item", F.get_json_object("content", "$.headline").alias("main"), F.get_json_object("content", "$.event_type").alias("inner_text"))


# --- T5, W10: recent sums by event time ------------------------------------------------------


@query("""SELECT strftime(make_timestamp(CAST(w AS BIGINT) * 20000000), '%Y-%m-%d %H:%M:%S') AS from_time, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(range(CAST(floor(epoch(ts) / 20) AS BIGINT) - 2, CAST(floor(epoch(ts) / 20) AS BIGINT) + 1)) AS w FROM events) GROUP BY 1, 2""")
def sliding_windows(spark, d):
    """Sums over each minute that begins every twenty seconds."""
    e = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sliding_sums(e, "ts", "event_type", "value", "60 seconds", "20 seconds").select(F.date_format("from", "yyyy-MM-dd HH:mm:ss").alias("from_time"), "event_type", "n", F.round("total", 4).alias("total"))
