"""Golden values of scalar functions, extraction and state machines."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions import vocab as V
from ledgerline.functions.python_udfs import canonical, link_density, number
from ledgerline.operators import audit, claims, dml, documents, entities, extraction as X, recipe_records, state
from ledgerline.sources import store


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("49,000", 49000.0), ("$1,234.50", 1234.5), ("~ 12", 12.0), ("est. 5", 5.0), ("e88,000", 88000.0), ("1.5e3", 1500.0), ("1.234,56", None), ("12 t", 12.0), ("-3,000 USD", -3000.0),
        ("", None), (None, None), ("abc", None), ("1,23", 1.0), ("€ 7", 7.0), ("nan", None), ("+5", 5.0),
    ],
)
def test_number(text, want):
    assert number(text) == want


def test_canonical_json():
    assert canonical({"b": 142000.0, "a": [1, None, True, "é"]}) == '{"a":[1,null,true,"é"],"b":142000.0}'


def test_link_density():
    assert link_density("<script>x</script><a href='x'>ab  c</a> de<!-- no -->") == {"anchor": 4, "other": 3}


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_columns(spark):
    lit = F.lit
    assert _one(spark, T.mime(lit(" Text/HTML; charset=x"))) == "text/html"
    assert _one(spark, T.mime(lit(None).cast("string"))) == "application/octet-stream"
    assert _one(spark, T.stripped_html(lit("<p>a&amp;b<script>x</script> &lt;c&gt;</p>"))) == "a&b <c>"
    assert _one(spark, T.scrubbed(lit("Bearer abc sk-ant-abcdefgh"))) == "Bearer *** sk-ant-***efgh"
    assert _one(spark, V.is_entity_id(lit("a b"))) is False
    assert _one(spark, V.is_topic(lit("ok\n"))) is False
    assert _one(spark, V.clamped_confidence(lit(float("inf")))) == 0.0
    assert _one(spark, entities.exemplar_name(lit("mine:green_bushes"))) == "green bushes"


def test_json_path(spark):
    rows = [('{"data":{"production":{"chile":49000}}}', "$.data.production.chile"), ('{"label":"Annual production"}', "$.label"), ('{"a":1}', "$.b"), ("not json", "$.a"), ('{"x":[null,2]}', "$.x[*]"), ('{"x":[null,null]}', "$.x[*]")]
    got = spark.createDataFrame(rows, "p string, q string").select(X.json_path(F.col("p"), F.col("q")).alias("r")).collect()
    assert [(r.r.value, r.r.error) for r in got] == [("49000", None), ("Annual production", None), (None, "no match"), (None, "not JSON"), ("2", None), (None, "no match")]


def test_markup_and_cells():
    assert X.selected("<table><tr><td class='prod'>49,000</td></tr></table>", "td.prod", None) == ["49,000"]
    assert X.selected("<a href='https://example.com/file.pdf'>report</a>", "a", "href") == ["https://example.com/file.pdf"]
    table = "country,production\nAustralia, 88000\nChile,49000\nArgentina,6200\n"
    assert X.cell(table, "production", "country", "Chile") == ("49000", None)
    assert X.cell(table, "production", None, None)[1] == "3 rows match"
    assert X.tables("a  b\n1  2\n\n3  4\nend") == [[["a", "b"], ["1", "2"], ["3", "4"]]]


def test_iterator_caps(spark):
    rows = [("{}",), ('{"s":[' + ",".join('{"n":1}' for _ in range(501)) + "]}",), ('{"s":[{"n":1},{"n":2}]}',)]
    got = X.json_records(spark.createDataFrame(rows, "p string"), "p", "$.s", {"n": "$.n"}).collect()
    assert sorted((r.n or "", r.error or "") for r in got) == [("", "no match"), ("", "too many matches"), ("1", ""), ("2", "")]


def test_capped_page(spark):
    assert _one(spark, X.capped_page(F.lit("https://x/odata/t#f"), 5)) == "https://x/odata/t?$top=5#f"
    assert _one(spark, X.capped_page(F.lit("https://x/t?$top=9"), 5)) == "https://x/t?$top=5"
    assert _one(spark, X.capped_page(F.lit("https://x/t?$top=2"), 5)) == "https://x/t?$top=2"
    assert _one(spark, X.capped_page(F.lit("https://x/t"), 5)) == "https://x/t"


def test_promotion_is_idempotent_and_counts_stances_together(spark):
    at = dt.datetime(2026, 5, 16, 12)
    rows = [(i, f"agency:{c}", "owns", "company:a", to, "s", 0.5, at) for i, (c, to) in enumerate([("x", "mine:1"), ("y", "mine:1"), ("z", "mine:1"), ("x", "mine:2"), ("x", "mine:2")])]
    c = spark.createDataFrame(rows, "id long, claimant string, kind string, rel_from string, rel_to string, source_id string, confidence double, observed_at timestamp")
    none = spark.createDataFrame([], "claimant string, topic string, quorum int")
    facts = claims.promote(c, none, spark.createDataFrame([], "dedup_key string"), ("lithium",))
    assert [(r.rel_to, r.n_claimants) for r in facts.collect()] == [("mine:1", 3)]
    assert claims.promote(c, none, facts.select("dedup_key"), ("lithium",)).count() == 0
    seed = spark.createDataFrame([("X", None, None)], "claimant string, topic string, quorum int")
    assert sorted((r.rel_to, r.source_id) for r in claims.promote(c, seed, spark.createDataFrame([], "dedup_key string"), ("lithium",)).collect()) == [("mine:1", "derived#authoritative"), ("mine:2", "derived#authoritative")]


def test_tier_matrix(spark):
    rows = [(1, "e", "k1", "one", "unknown", 1.0, 1), (2, "e", "k2", "two", "extracted", 2.0, 2), (3, "e", "k3", "three", "classifier-emitted", 3.0, 3)]
    e = spark.createDataFrame(rows, "seq long, entity_id string, kind string, canonical_name string, license string, score double, nation long")
    r = entities.tiered_upsert(e).first()
    assert (r.seq, r.score, r.canonical_name, r.tier) == (1, 1.0, "two", 3)
    assert [(x.seq, x.old_tier, x.new_tier, x.name_changed) for x in entities.refresh_log(e).collect()] == [(2, 1, 3, True)]


def test_near_misses(spark):
    words, names = spark.createDataFrame([("relaton",), ("evnet",), ("relation",), ("cat",), ("x",)], "w string"), spark.createDataFrame([("relation",), ("event",), ("cap",), ("car",)], "n string")
    assert {r.w: r.suggestion for r in T.near_misses(words, "w", names, "n").collect()} == {"relaton": "relation", "evnet": "event"}


def test_trim_keeps_ties(spark):
    log = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, 1)], "id long, at long")
    assert sorted(r.id for r in audit.trimmed(log, "at", 2).collect()) == [1, 2, 3]
    assert audit.trimmed(log, "at", 0).count() == 0


def test_index_signal(spark):
    long = "word " * 200
    rows = [("https://x.org/tag/a", f"<p>{long}</p>"), ("https://x.org/a", f"<p>{long}</p>"), ("https://x.org/b", "<a href=x>" + long + long + "</a>" + long), ("https://x.org/c", "short")]
    got = documents.with_index_signal(spark.createDataFrame(rows, "url string, page string").withColumn("mime", F.lit("text/html")), "page", "mime", "url").collect()
    assert [r.signal for r in got] == ["index", "article", "index", "unknown"]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    assert dml.deleted(t, spark.createDataFrame([(1,)], "id long"), ["id"]).count() == 2
    assert [r.v for r in dml.updated(t, "id = 2", v="z").orderBy("v").collect()] == ["a", "c", "z"]


def test_registry_and_sources(spark):
    r = store.registry_from_toml(spark, '[[entry]]\nclaimant = "agency:a"\nquorum = 0\n[[entry]]\nclaimant = "b"\ntopic = "t"\nquorum = 2\n').collect()
    assert [(x.claimant, x.topic, x.quorum) for x in r] == [("agency:a", None, None), ("b", "t", 2)]
    assert store.sources_from_toml(spark, '[[source]]\nname = "x"\n').first().name == "x"
    with pytest.raises(KeyError):
        store.found(spark.range(1), "id", 7)


def test_round_trip_of_records(spark, tmp_path):
    rows = [("1", "event", ["e:1"], ["CL"], ["t"], [("0", "document", "extraction")], "x")]
    r = spark.createDataFrame(rows, "id string, record_type string, entities array<string>, places array<string>, topics array<string>, derived_from array<struct<parent_id:string,parent_type:string,role:string>>, body string")
    store.written(r, str(tmp_path), "b1")
    store.written(r, str(tmp_path), "b1")  # a batch written again after a failure replaces itself
    got = store.read_records(spark, str(tmp_path)).first()
    assert (got.id, got.entities, got.topics, got.body) == ("1", ["e:1"], ["t"], "x")


def test_a_cycle_in_a_lineage_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 99)], "id long, parent long")
    with pytest.raises(Exception, match="cycle in the lineage"):
        state.lineage(rows, "id", "parent").collect()
    with pytest.raises(Exception, match="cycle in the lineage"):
        state.lineage(rows, "id", "parent", start="id = 2").collect()
    assert sorted((r.root, r.depth, r.id) for r in state.lineage(rows, "id", "parent", start="id > 3").collect()) == [(4, 0, 4), (5, 0, 5)]
    long = spark.createDataFrame([(i, i + 1) for i in range(50)], "id long, parent long")
    assert state.lineage(long, "id", "parent", start="id = 0").count() == 32


def test_audit_rows_are_appended_once(spark, tmp_path):
    for batch, rows in (("1", [(1, "a")]), ("2", [(2, "b")]), ("2", [(2, "b"), (3, "c")])):
        store.appended(spark.createDataFrame(rows, "id long, kind string"), str(tmp_path / "outcomes"), batch)
    assert sorted((r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "outcomes")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_attribute_values_as_tiles_show_them(spark):
    cases = {
        '{"kind":"number","value":{"value":1234567.5,"unit":"t"}}': "1,234,567.5 t", '{"kind":"number","value":{"value":3}}': "3", '{"kind":"boolean","value":false}': "false", '{"kind":"text","value":"x y"}': "x y", '{"kind":"country","value":"CL"}': "CL",
        '{"kind":"entity_list","value":["a"]}': '{"kind":"entity_list","value":["a"]}',
    }
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", store.attribute_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == cases


def test_reports_are_appended(spark, tmp_path):
    for n in (1, 2):
        store.appended_jsonl(spark.createDataFrame([(n,)], "trial long"), str(tmp_path / "r"))
    assert sorted(r.trial for r in spark.read.json(str(tmp_path / "r")).collect()) == [1, 2]


def test_pointers_and_assembly():
    plan = '{"a": {"b": [1, {"c": "x"}]}, "n": null}'
    assert recipe_records.walked({"a": {"b": [1, {"c": "x"}]}}, "a.b.1.c") == "x" and recipe_records.walked({"a": [1]}, "a.1") is None and recipe_records.walked({"a": 1}, "a.b") is None
    made = recipe_records.assembled("relation", [("kind", "literal", '"k"'), ("from", "from_plan", "a.b.0"), ("to", "extracted", " 22 "), ("magnitude.unit", "inner", "1,200"), ("magnitude.value", "inner", "1,200")], plan)
    assert made == ('{"from":"1","kind":"k","magnitude":{"unit":"1200.0","value":1200.0},"to":"22.0"}', None)
    assert recipe_records.assembled("event", [("event_type", "literal", '"e"'), ("event_type.x", "literal", "1")], plan)[1] == "path segment event_type expected an object"
    assert recipe_records.assembled("event", [("event_type", "from_plan", "z")], plan)[1] == "from_plan pointer z resolved to nothing"
    assert recipe_records.assembled("observation", [("metric", "literal", '"m"'), ("value", "extracted", "many"), ("unit", "literal", '"t"'), ("period", "literal", '"annual"')], plan)[1] == "observation content: missing or wrong value"
    assert recipe_records.assembled("document", [], plan)[1] == "document is not producible from a recipe"
