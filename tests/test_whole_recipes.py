"""Whole recipes: every mode, scopes of inner fields, bounds, registries with gates, and content hashes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import claims as C
from ledgerline.operators import documents as DOC
from ledgerline.operators import recipe_records as R
from ledgerline.plans.catalog_recipes import _recipes

EVENT = ("event", None, [("event_type", "literal", '"e"'), ("headline", "extracted", None)])


def _applied(spark, payload, *recipes):
    rows = spark.createDataFrame([(i, str(i), payload) for i in range(len(recipes))], "payload_id long, recipe_id string, payload string")
    got = R.applied(rows, _recipes(spark, *[{"recipe_id": str(i), "bindings": [EVENT]} | r for i, r in enumerate(recipes)]))
    out = [[] for _ in recipes]
    for r in got.orderBy("payload_id", "item", "binding").collect():
        out[r["payload_id"]].append(r["error"] or r["content"])
    return out


def _event(headline, **more):
    extra = "".join(f',"{k}":{v}' for k, v in more.items())
    return f'{{"event_type":"e","headline":"{headline}"{extra}}}'


def test_inner_fields_are_looked_for_in_the_first_match(spark):
    inner = ("event", None, [("event_type", "inner", None), ("headline", "inner", None)])
    recipe = {"path": "$.a", "inner": [("event_type", "$.k", None), ("headline", "$.v", None)], "bindings": [inner]}
    payload = '{"k":"outer","a":{"k":"in","v":"x"}}'
    assert _applied(spark, payload, recipe) == [['{"event_type":"in","headline":"x"}']]
    page = "<b>outer</b><div><b>in</b><i>x</i></div><div><b>later</b></div>"
    css = {"mode": "css_select", "path": "div", "inner": [("event_type", "b", None), ("headline", "i", None)], "bindings": [inner]}
    assert _applied(spark, page, css) == [['{"event_type":"in","headline":"x"}']]


def test_first_matches_that_are_not_null(spark):
    payload = '{"data":[{"v":null},{"v":"x"},{"v":3}],"n":null}'
    got = _applied(spark, payload, {"path": "$.data[*].v"}, {"path": "$.n"}, {"path": "$.gone"}, {"iterator_mode": "json_path", "iterator_path": "$.data", "path": "$.v", "bindings": [("event", "headline", EVENT[2])]})
    assert got == [[_event("x")], ["no match"], ["no match"], ["no match"]]
    assert _applied(spark, "{", {"path": "$.a"}, {"iterator_mode": "json_path", "iterator_path": "$.a", "path": "$"}) == [["not JSON"], ["not JSON"]]


def test_one_error_fails_the_payload_and_no_other_recipe(spark):
    payload = '{"l":[{"v":"a"},{"v":""},{"v":"c"}]}'
    many = {"iterator_mode": "json_path", "iterator_path": "$.l", "path": "$.v", "bindings": [("event", "headline", EVENT[2])]}
    assert _applied(spark, payload, many, {"path": "$.l[0].v"}) == [["no match"], [_event("a")]]


def test_cells_patterns_and_pages(spark):
    table = "country,production\nAustralia,88000\nChile,49000\n"
    csv = {"mode": "csv_cell", "path": "production", "filter_column": "country"}
    number = [(*EVENT[:2], [EVENT[2][0], ("headline", "literal", '"h"'), ("magnitude.value", "extracted", None)])]
    got = _applied(spark, table, csv | {"filter_value": "Chile", "bindings": number}, csv | {"filter_column": None}, csv | {"path": "gone"}, csv | {"filter_value": "Peru"})
    assert got == [[_event("h", magnitude='{"value":49000.0}')], ["2 rows match"], ["no such column"], ["0 rows match"]]
    assert _applied(spark, "a 12 b", {"mode": "regex_capture", "path": "([0-9]+)"}, {"mode": "regex_capture", "path": "(b)|(c)", "grp": 2}) == [[_event("12.0")], ["no match"]]
    pages = "cover\fName Value\nx 5\ny 6"
    spot = lambda *s: {"mode": "pdf_table", "path": None, "spot": list(s)}
    assert _applied(spark, pages, spot(2, 0, 2, 0), spot(2, 1, 0, 0), spot(3, 0, 0, 0)) == [[_event("y")], ["no such cell"], ["no such cell"]]


def test_long_errors_and_values(spark):
    path = "a" * 700 + ":hover"
    (error,) = _applied(spark, "<a>", {"mode": "css_select", "path": path})[0]
    assert len(error) == 601 and error.startswith("selector not supported: aaa") and error.endswith(":hover") and "…" in error
    assert _applied(spark, "x" * 2048, {"mode": "regex_capture", "path": "x+", "grp": 0}) == [[_event("x" * 2048)]]
    assert _applied(spark, "x" * 2049, {"mode": "regex_capture", "path": "x+", "grp": 0}) == [["value too long"]]


def test_null_payloads(spark):
    assert _applied(spark, None, {"path": "$.a"}, {"mode": "css_select", "path": "a"}, {"mode": "csv_cell", "path": "a"}, {"mode": "regex_capture", "path": "a"}, {"mode": "pdf_table", "spot": [1, 0, 0, 0]}) == [["not JSON"], ["no match"], ["no such column"], ["no match"], ["no such cell"]]


def test_a_recipe_without_its_columns_is_refused(spark):
    rows = spark.createDataFrame([("x",)], "p string")
    with pytest.raises(Exception, match="the recipe lacks"):
        rows.lateralJoin(R.ExtractRecords(F.col("p").outer(), F.struct(F.col("p").outer().alias("mode")), F.lit(None), F.lit(False))).collect()


# --- registries ------------------------------------------------------------------------------


def _fits(entry, claimant, metric, topics):
    who, wanted, topic, _ = entry
    names = {claimant.lower()} | {claimant.split(":", 1)[1].lower() for p in ("agency:", "publisher:", "source:") if claimant.startswith(p)}
    return who.lower() in names and (wanted is None or wanted == metric) and (topic is None or topic in topics)


def test_registry_gates_equal_all_pairs(spark):
    registry = [("a", None, None, None), ("Agency:B", "price", None, 1), ("b", None, "zinc", 2), ("publisher:c", "price", "lithium", 3), ("c", None, None, 5), ("agency:d", None, "zinc", 0), (" ", None, None, 1), ("source:a", None, None, 1), ("x:y", None, None, 2)]
    claims = [(i, who, metric, topics) for i, (who, metric, topics) in enumerate((w, m, t) for w in ("agency:a", "source:A", "agency:b", "publisher:C", "Agency:c", "agency:d", "x:y", "other:a") for m in ("price", None) for t in (["lithium", "zinc"], ["lithium"], [], None))]
    df = spark.createDataFrame(claims, "id long, claimant string, metric string, topics array<string>")
    got = {r["id"]: (r["alone"], r["lowered"]) for r in C.with_registry(df, spark.createDataFrame(registry, "claimant string, metric string, topic string, quorum int")).collect()}
    for i, who, metric, topics in claims:
        hits = [e for e in registry if e[0].strip() and _fits(e, who, metric, topics or [])]
        quorums = [e[3] for e in hits if e[3] is not None and e[3] >= 1]
        assert got[i] == (any((1 if e[3] is None else e[3]) <= 1 for e in hits), min(quorums) if quorums else None), (who, metric, topics)
    plan = C.with_registry(df, spark.createDataFrame(registry, "claimant string, metric string, topic string, quorum int"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_lowered_quorum_holds_for_its_groups_alone(spark):
    at = dt.datetime(2026, 1, 1)
    claim = lambda i, who, to, conf=0.5: (i, f"agency:{who}", "owns", "company:1", to, f"s{i}", conf, at + dt.timedelta(minutes=i))
    rows = [claim(1, "x", "mine:1"), claim(2, "y", "mine:1"), claim(3, "y", "mine:2"), claim(4, "z", "mine:2"), claim(5, "w", "mine:3", 0.25), claim(6, "w", "mine:3", 0.75), claim(7, "z", "mine:3", 0.1)]
    df = spark.createDataFrame(rows, "id long, claimant string, kind string, rel_from string, rel_to string, source_id string, confidence double, observed_at timestamp")
    registry = spark.createDataFrame([("x", None, None, 2), ("w", "owns", None, 1)], "claimant string, metric string, topic string, quorum int")
    facts = {r["rel_to"]: r for r in C.promote(df, registry, spark.createDataFrame([], "dedup_key string"), ("t",)).collect()}
    assert set(facts) == {"mine:1", "mine:3"}
    assert (facts["mine:1"]["n_support"], facts["mine:1"]["source_id"]) == (2, "derived#consensus")
    # A fact by authority rests on the newest claim alone.
    assert (facts["mine:3"]["n_support"], facts["mine:3"]["representative_id"], round(facts["mine:3"]["confidence"], 4), facts["mine:3"]["source_id"]) == (1, 6, 0.75, "derived#authoritative")


def test_asserted_contents_are_canonical(spark):
    cases = [
        ("observation", '{"unit":"t","metric":"m","value":142000,"period":"annual"}', '{"asserted_kind":"observation","currency":null,"metric":"m","period":"annual","unit":"t","value":142000,"value_uncertainty":null}'),
        ("observation", ' { "currency" : "USD" } ', '{"asserted_kind":"observation","currency":"USD","value_uncertainty":null}'),
        ("event", "{}", '{"asserted_kind":"event","direction":null}'),
        ("relation", '{"to":"b","from":"a","kind":"k\\u00e9\\"","magnitude":{"value":1e10,"unit":"t"}}', '{"asserted_kind":"relation","from":"a","kind":"ké\\"","magnitude":{"unit":"t","value":10000000000.0},"to":"b"}'),
        ("relation", "no json", None),
    ]
    df = spark.createDataFrame([(i, k, c) for i, (k, c, _) in enumerate(cases)], "i int, k string, c string")
    assert [r["x"] for r in df.select("i", C.asserted(F.col("k"), F.col("c")).alias("x")).orderBy("i").collect()] == [w for _, _, w in cases]


def test_a_preview_of_a_cull(spark):
    claims = spark.createDataFrame([(i, "s1" if i % 2 else "s2", "event", i) for i in range(200)], "id long, source_id string, content_kind string, observed_at long")
    pages = spark.createDataFrame([("s1", "https://h.org/Tag/" + "x" * 100, "index", 2, 1), ("s1", "https://h.org/old", "article", 1, 2), ("s2", "https://h.org/", "article", 1, 3)], "source_id string, source_url string, signal string, observed_at long, id long")
    got = DOC.cull_preview(claims, pages).collect()
    assert [r["id"] for r in got] == list(range(199, 99, -2)) and {len(r["source_path"]) for r in got} == {80} and got[0]["source_path"].startswith("/Tag/x")
