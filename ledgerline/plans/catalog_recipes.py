"""Queries of whole recipes: iterated and scalar records, failures, probes, pointers; and markup and index signals with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import recipe_records as R
from ..sources import bridge as B
from . import catalog_store as _before  # the queries before these
from .catalog import query

catalog = _before.catalog
PLAN = '{"topic":"wind","tags":["a","b"],"scope":{"regions":[{"name":"north"}]}}'


def _recipes(spark, *rows):
    """Recipes with defaults for what a row does not say."""
    base = {"recipe_id": "r", "source_id": "src", "version": 2, "source_url": "https://x.org/f", "mode": "json_path", "path": "$.v", "attribute": None, "iterator_mode": None, "iterator_path": None, "inner": [], "topics": ["wind", "storms"], "plan": PLAN, "bindings": [], "grp": None, "filter_column": None, "filter_value": None, "spot": None}
    names = list(base)
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], R.RECIPE)


_EVENT = ("event", "headline", [("event_type", "literal", '"storm"'), ("headline", "inner", None), ("magnitude.value", "extracted", None), ("magnitude.unit", "literal", '"kt"'), ("magnitude.metric", "from_plan", "scope.regions.0.name")])
_ENTITY = ("entity", "entity_id", [("entity_id", "inner", None), ("kind", "literal", '"storm"'), ("canonical_name", "extracted", None)])
_STORMS = "s AS (SELECT o_orderkey AS id, i, 'storm ' || (o_orderkey + i) AS name, o_orderkey % 1000 + 1000 * i AS wind FROM orders, (SELECT unnest([0, 1, 2]) AS i))"


def _storm_payloads(spark, d):
    item = lambda i: F.concat(F.lit('{"name":"storm '), F.col("o_orderkey") + i, F.lit('","id":"st:'), F.col("o_orderkey") + i, F.lit('","wind":"'), F.format_number(F.col("o_orderkey") % 1000 + 1000 * i, 0), F.lit(' kt"}'))
    return B.spread(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("payload_id"), F.lit("r").alias("recipe_id"), F.concat(F.lit('{"storms":['), F.concat_ws(",", item(0), item(1), item(2)), F.lit("]}")).alias("payload"))


@query("WITH " + _STORMS + """ SELECT id AS payload_id, CAST(i AS INT) AS item, 0 AS binding, 'event' AS record_type, 'r:' || name AS dedup_key, '{"event_type":"storm","headline":"' || name || '","magnitude":{"metric":"north","unit":"kt","value":' || wind || '.0}}' AS content, 'src#recipe:r@v2' AS source_id, 'json:$.storms >> json:$.wind' AS selector_path, 'wind,storms' AS topics FROM s""")
def recipe_records(spark, d):
    """JSON arrays iterated to events with extracted, literal, plan and inner fields."""
    recipe = {"iterator_mode": "json_path", "iterator_path": "$.storms", "path": "$.wind", "inner": [("headline", "$.name", None)], "bindings": [_EVENT]}
    return R.applied(_storm_payloads(spark, d), _recipes(spark, recipe)).select("payload_id", "item", "binding", "record_type", "dedup_key", "content", "source_id", "selector_path", F.array_join("topics", ",").alias("topics"))


@query("WITH " + _STORMS + """ SELECT record_type, count(*) AS n, min(content) AS least FROM (SELECT 'event' AS record_type, '{"event_type":"storm","headline":"' || name || '","magnitude":{"metric":"north","unit":"kt","value":' || wind || '.0}}' AS content FROM s UNION ALL SELECT 'entity', '{"canonical_name":"' || wind || '.0","entity_id":"st:' || (id + i) || '","kind":"storm"}' FROM s) GROUP BY 1""")
def records_of_two_bindings(spark, d):
    """Matches times bindings; a number in a field of text becomes its text."""
    recipe = {"iterator_mode": "json_path", "iterator_path": "$.storms", "path": "$.wind", "inner": [("headline", "$.name", None), ("entity_id", "$.id", None)], "bindings": [_EVENT, _ENTITY]}
    return R.applied(_storm_payloads(spark, d), _recipes(spark, recipe)).groupBy("record_type").agg(F.count("*").alias("n"), F.min("content").alias("least"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(.*?)</li>', 1)) AS li, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(.*?)</li>', 1), 1) - 1 AS item FROM pages)
SELECT page_id AS payload_id, CAST(item AS INT) AS item, 'r:' || left(regexp_extract(li, 'href="([^"]*)"', 1), 200) AS dedup_key, regexp_extract(li, 'href="([^"]*)"', 1) AS excerpt, 'css:nav li >> css:a[href]' AS selector_path FROM l""")
def records_of_menus(spark, d):
    """Menu items of pages as relations: a selector within each element of another."""
    binding = ("relation", "from", [("kind", "literal", '"links"'), ("from", "extracted", None), ("to", "inner", None)])
    recipe = {"mode": "css_select", "iterator_mode": "css_select", "iterator_path": "nav li", "path": "a", "attribute": "href", "inner": [("to", "a", None)], "bindings": [binding]}
    pages = B.table(spark, d, "pages").select(F.col("page_id").alias("payload_id"), F.lit("r").alias("recipe_id"), F.col("html").alias("payload"))
    return R.applied(pages, _recipes(spark, recipe)).select("payload_id", "item", "dedup_key", "excerpt", "selector_path")


_FAIL = "CASE o_orderkey % 6 WHEN 0 THEN 'no match' WHEN 1 THEN 'entity content: missing or wrong kind' WHEN 2 THEN 'too many matches' WHEN 3 THEN 'iterator not implemented: css_select x json_path' WHEN 4 THEN 'document is not producible from a recipe' ELSE 'dedup field is constant across records' END"


@query(f"SELECT {_FAIL} AS error, count(*) AS n FROM orders GROUP BY 1")
def failed_recipes(spark, d):
    """Each kind of error fails its payload as a whole, good items or not."""
    many = {"iterator_mode": "json_path", "iterator_path": "$.a", "path": "$"}
    entity = ("entity", "entity_id", [("entity_id", "extracted", None), ("canonical_name", "literal", '"n"')])
    event = ("event", "headline", [("event_type", "literal", '"e"'), ("headline", "extracted", None)])
    recipes = _recipes(
        spark,
        many | {"recipe_id": "0", "bindings": [event]}, many | {"recipe_id": "1", "bindings": [event, entity]}, many | {"recipe_id": "2", "bindings": [event]}, many | {"recipe_id": "3", "iterator_mode": "css_select", "bindings": [event]},
        many | {"recipe_id": "4", "bindings": [("document", "t", [("t", "extracted", None)])]}, many | {"recipe_id": "5", "bindings": [("event", "headline", [("event_type", "extracted", None), ("headline", "from_plan", "topic")])]},
    )
    which = F.col("o_orderkey") % 6
    listed = F.when(which == 0, F.array().cast("array<string>")).when(which == 2, F.array_repeat(F.lit('"x"'), 501)).otherwise(F.array(F.lit('"x"'), F.lit('"y"')))
    payloads = B.spread(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("payload_id"), which.cast("string").alias("recipe_id"), F.concat(F.lit('{"a":['), F.array_join(listed, ","), F.lit("]}")).alias("payload"))
    return R.applied(payloads, recipes).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS payload_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 4) * 200 ELSE 1 END AS INT) AS n_items, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 > 0 ELSE o_orderkey % 3 > 0 END AS ok FROM orders")
def probed_recipes(spark, d):
    """Probes at authoring time: an iterator with 400 and more matches is sound, one with none is not."""
    recipes = _recipes(spark, {"recipe_id": "0", "iterator_mode": "json_path", "iterator_path": "$.a", "path": "$"}, {"recipe_id": "1", "path": "$.b"})
    k = F.col("o_orderkey")
    payloads = B.spread(spark, d, "orders", "o_orderkey").select(k.alias("payload_id"), (k % 2).cast("string").alias("recipe_id"), F.concat(F.lit('{"a":['), F.array_join(F.array_repeat(F.lit("7"), (k % 4 * 200).cast("int")), ","), F.lit("]"), F.when(k % 3 > 0, ',"b":1').otherwise(""), F.lit("}")).alias("payload"))
    return R.probed(payloads, recipes).select("payload_id", "n_items", "ok")


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS DOUBLE) WHEN 1 THEN 1234.5 WHEN 2 THEN CAST(c_custkey AS DOUBLE) END AS value FROM customer")
def parsed_scalars(spark, d):
    """Plain floats, numbers as people write them, estimates, and texts."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), k, F.lit(".0"))).when(k % 4 == 1, F.lit("est. $1,234.5")).when(k % 4 == 2, F.concat(F.lit("~"), k, F.lit(" t"))).otherwise(F.lit("1.234,5"))
    return B.table(spark, d, "customer").select(k.alias("id"), X.parsed_scalar(F.trim(text)).alias("value"))


@query("SELECT c_custkey AS id, 'r' || (c_custkey % 3) || ':' || repeat('k', least(c_custkey % 400, 200)) AS key, CASE WHEN c_custkey % 400 > 256 THEN repeat('k', 256) || '…' ELSE repeat('k', c_custkey % 400) END AS excerpt FROM customer")
def record_keys(spark, d):
    k = F.col("c_custkey")
    value = F.repeat(F.lit("k"), (k % 400).cast("int"))
    return B.table(spark, d, "customer").select(k.alias("id"), X.record_key(F.concat(F.lit("r"), k % 3), value).alias("key"), X.excerpt(value).alias("excerpt"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN '2 rows match' WHEN n_nationkey % 3 = 1 THEN 'no such column' ELSE '0 rows match' END AS csv_error, CASE WHEN n_nationkey % 2 = 0 THEN 'no such cell' ELSE 'no match' END AS error FROM nation")
def refused_cells(spark, d):
    """What is ambiguous, missing or beyond a bound is an error."""
    k = F.col("n_nationkey")
    text = F.lit("name,value\na,1\na,2\n")
    csv = X.csv_cell(text, F.when(k % 3 == 1, F.lit("gone")).otherwise(F.lit("value")), F.lit("name"), F.when(k % 3 == 2, F.lit("b")).otherwise(F.lit("a")))
    table = X.table_cell(F.array(F.lit("one line")), F.array(F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    regex = X.regex_capture(F.lit("abc"), F.lit("([0-9]+)"), F.lit(1))
    return B.table(spark, d, "nation").select(k.alias("id"), csv.alias("c"), table.alias("t"), regex.alias("r")).select("id", F.col("c.error").alias("csv_error"), F.when(F.col("id") % 2 == 0, F.col("t.error")).otherwise(F.col("r.error")).alias("error"))
