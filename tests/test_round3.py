"""What the third round found: rows that differed from SQL, and work that did not spread."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerline.operators import audit
from ledgerline.operators import extraction as X
from ledgerline.operators import html_digest as H
from ledgerline.operators import json_shapes as J
from ledgerline.operators import presentation as P
from ledgerline.operators import recipe_records as R
from ledgerline.plans.catalog_recipes import _recipes


def test_a_rolling_sum_counts_fractions_of_a_second(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.4", 1.0), (2, "2024-01-01 00:01:00.5", 2.0), (3, "2024-01-01 00:01:00.7", 4.0), (4, "2024-01-01 00:02:00.5", 8.0)], "id long, t string, v double")
    got = audit.rolling_sum(rows.select("id", F.lit(1).alias("k"), F.col("t").cast("timestamp").alias("t"), "v"), "k", "t", "v", 60)
    assert {r["id"]: r["rolling"] for r in got.collect()} == {1: 1.0, 2: 2.0, 3: 6.0, 4: 14.0}


_LOOSE = "<title>a&amp</title><h1 id='x&lt'>b &amp; c&amp d&copy;&ampx;&#65;&#65</h1><script>1 && 2</script>"


def test_headings_decode_closed_references_alone(spark):
    got = H.headings(H.page_elements(spark.createDataFrame([(1, _LOOSE)], "id long, html string"), "id", "html"), "id").orderBy("tag").collect()
    assert [(r["tag"], r["text"]) for r in got] == [("h1", "b & c&amp d©&ampx;A&#65"), ("title", "a&amp")]


def test_selected_texts_decode_closed_references_alone():
    assert X.selected(_LOOSE, "h1", None) == ["b & c&amp d©&ampx;A&#65"]
    assert X.selected(_LOOSE, "h1", "id") == ["x&lt"]
    assert X.selected(_LOOSE, "script", None) == ["1 && 2"]


def test_selectors_see_only_what_is_in_their_element():
    page = X.Page("<ul><li class=a><b>1</b><p>x<p>y<li><b>2</b><i><b>3</b></i></ul><b>4</b>")
    first, second = page.selected("ul > li")
    assert [page.value(e, None) for e in page.selected("b", second)] == ["2", "3"]
    assert page.selected("li b", second) == [] and [page.value(e, None) for e in page.selected("p:nth-child(3)", first)] == ["y"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recipes_go_to_the_payloads(spark):
    """Payloads of one recipe are neither shuffled nor gathered in the task of that recipe."""
    event = ("event", "headline", [("event_type", "literal", '"e"'), ("headline", "extracted", None)])
    recipes = _recipes(spark, {"iterator_mode": "json_path", "iterator_path": "$.a", "path": "$", "bindings": [event]})
    payloads = spark.range(0, 8, 1, 4).select(F.col("id").alias("payload_id"), F.lit("r").alias("recipe_id"), F.concat(F.lit('{"a":['), F.array_join(F.array_repeat(F.lit("7"), (F.col("id") * 100).cast("int")), ","), F.lit("]}")).alias("payload"))
    for made in (R.applied(payloads, recipes), R.probed(payloads, recipes)):
        plan = _plan(made)
        assert "BroadcastExchange" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    n = {r["payload_id"]: (r["n"], r["e"]) for r in R.applied(payloads, recipes).groupBy("payload_id").agg(F.count("*").alias("n"), F.max("error").alias("e")).collect()}
    assert n == {0: (1, "no match"), **{i: (100 * i, None) for i in range(1, 6)}, 6: (1, "too many matches"), 7: (1, "too many matches")}
    assert {r["payload_id"]: (r["n_items"], r["ok"]) for r in R.probed(payloads, recipes).collect()} == {i: (100 * i, i > 0) for i in range(8)}


def test_charts_and_outlines_are_made_within_the_row(spark):
    """A document's series and lines need no shuffle, and a cut document is repaired once."""
    doc = '{"name":"n","t":{"timestamp":[1,2],"Close":[3,4.5],"x":[1,null]},"b":[5,6],"cut":[1'
    rows = spark.createDataFrame([(1, doc), (2, None), (3, "no"), (4, '{"v":[1.50,"a"]} ')], "id long, body string")
    charts, outlines = J.chart_catalogs(rows, ["id"], "body"), J.json_outlines(rows, ["id"], "body")
    assert "Exchange" not in _plan(charts) + _plan(outlines)
    assert [tuple(r) for r in charts.orderBy("place").collect()] == [(1, 0, "close", [1.0, 2.0], [3.0, 4.5], "n"), (1, 1, "b", [1.0, 2.0], [5.0, 6.0], "n")]
    assert {r["id"]: r["outline"].split("\n")[3] for r in outlines.collect()} == {4: '$.v[] : number|string   ← polymorphic; first 2 values: ["1.5", "\\"a\\""]'}


def test_bodies_of_fetches_are_computed_once(spark):
    fetches = spark.createDataFrame([("s", "r", 1, "u", "text/html", "<p>" + "é" * 20000, "2024")], "source_id string, recipe_id string, version int, source_url string, content_type string, body string, fetched_at string").withColumn("topics", F.array())
    made = P.fetched_documents(fetches)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("<script") == 1
    assert made.first()["body"] == "é" * 16384


def test_no_task_meets_all_rows_of_a_metric(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)], "id long").select((F.col("id") * 0).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("day"), "id")
    got = P.placed(rows, "k", "day", [F.desc("day"), F.desc("id")])
    want = sorted(range(40), key=lambda i: (-(i % 9), -i))
    assert [r["id"] for r in got.orderBy("place").collect()] == want
    assert re.search(r"hashpartitioning\(k#\w+, day#\w+", _plan(got)) and not re.search(r"hashpartitioning\(k#\w+, \d", _plan(got))


def test_a_digest_is_made_in_one_pass(spark):
    """Pages are read once and a few at a time, and nothing of a digest is joined."""
    pages = spark.createDataFrame([(1, "<title>t</title><h1>a</h1><ul class=x><li class=y>1<li class=y>2</ul>")], "id long, html string")
    plans = [_plan(H.digests(pages, "id", "html", 500)), _plan(H.page_elements(pages, "id", "html"))]
    assert all(p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p and "Join" not in p and "Exchange" not in p for p in plans)
    assert H.digests(pages, "id", "html", 500).first()["digest"].startswith('--- HTML structure ---\n<title>: t\n<h1>: a\n\nLists:\n  <ul class="x"> (2 items)\n\nRepeating element classes (iterator-eligible):\n  li.y: 2 occurrences\n')
