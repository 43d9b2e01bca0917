"""Shapes of documents against plain versions: repair, paths, tables, charts, pages, references, names."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import extraction as X
from ledgerline.operators import html_digest as H
from ledgerline.operators import json_shapes as J


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# --- D10 -------------------------------------------------------------------------------------


def _repaired(text):
    """Character by character, as the rule says."""
    stack, end, tail, inside, skip = [], 0, "", False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c or not stack:
                return None
            end, tail = i + 1, "".join(reversed(stack))
    return text[:end] + tail if end else None


def _random_json(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice([None, True, 1, -2.5, "", "a]b}", 'q"\\', "é\n{", "[", "😀"])
    if kind < 0.65:
        return [_random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b", 'k"', "é", "7", "timestamp", "}{"]) + str(i): _random_json(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_every_prefix_of_a_document_is_repaired(spark):
    rng = random.Random(1)
    docs = [json.dumps({"first": [1], "rest": _random_json(rng)}, ensure_ascii=rng.random() < 0.5) for _ in range(25)]
    rows = [(d[:n],) for d in docs for n in range(len(d) + 1)] + [("{]",), ("[}",), ("]",), ('{"a":[1]]',), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", J.recovered(F.col("t")).alias("r"), J.nesting(F.col("t")).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["r"] == (None if r["t"] is None else _repaired(r["t"]))
        if r["r"] is not None:
            json.loads(r["r"])
    whole = [r for r in got if r["t"] in docs]
    assert all(r["r"] is None for r in whole)
    prefixes = {r["t"]: r["r"] for r in got if r["t"] is not None}
    # Once the first list is closed, every proper prefix parses after its repair.
    assert all(prefixes[d[:n]] is not None for d in docs for n in range(len('{"first": [1]'), len(d)))


# --- A26, N17 --------------------------------------------------------------------------------


def _paths(value, path="$", out=None):
    out = [] if out is None else out
    kind = {type(None): "null", bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]
    out.append((path, kind, len(value) if kind == "array" else None))
    if kind == "object":
        for k in sorted(value):
            _paths(value[k], f"{path}.{k}", out)
    elif kind == "array":
        for v in value:
            _paths(v, path + "[]", out)
    return out


def test_paths_of_random_documents(spark):
    rng = random.Random(4)
    docs = [_random_json(rng) for _ in range(60)]
    docs = [d for d in docs if isinstance(d, (dict, list))]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "no json"), (901, None), (902, "")]
    got = J.json_paths(spark.createDataFrame(rows, "id long, j string"), ["id"], "j").orderBy("id", "place").collect()
    want = [(i, *p) for i, d in enumerate(docs) for p in _paths(d)]
    assert [(r["id"], r["path"], r["kind"], r["length"]) for r in got] == want


def test_an_outline_as_a_whole(spark):
    doc = {"data": [{"country": "A", "value": None}, {"country": "B", "value": 12}, {"country": "C", "value": 1.5}], "meta": {"total": 3, "empty": []}, "x": ["s" * 200]}
    got = J.json_outlines(spark.createDataFrame([(1, json.dumps(doc)), (2, "[]"), (3, json.dumps({f"k{i:02}": i for i in range(60)}))], "id long, j string"), ["id"], "j")
    text = {r["id"]: r["outline"] for r in got.collect()}
    lines = text[1].split("\n")
    assert lines[:5] == ["--- JSON shape ---", "$ : object", "$.data : array[3]", "$.data[] : object", "$.data[].country : string"]
    assert lines[5] == '$.data[].value : null|number   ← polymorphic; first 3 values: ["null", "12", "1.5"]'
    assert "$.meta.empty : array[0]" in lines and "--- First 2 elements of $.data ---" in lines
    head = text[1].split("of $.data ---\n")[1].split("\n--- end")[0]
    assert json.loads(head) == doc["data"][:2] and head.startswith('[\n  {\n    "country"')
    assert text[2] == "--- JSON shape ---\n$ : array[0]\n--- end JSON shape ---\n"
    assert text[3].count("\n") == 53 and "  [... 11 more paths truncated]\n" in text[3]


# --- D9, D11 ---------------------------------------------------------------------------------


def _order(d):
    keys = list(d)
    numbers = sorted((k for k in keys if k.isdigit() and (k == "0" or k[0] != "0") and len(k) < 10), key=int)
    return numbers + [k for k in keys if k not in numbers]


def _tables(node, path, out):
    if isinstance(node, list):
        if len(node) >= 2 and all(isinstance(x, dict) for x in node):
            out.append((0, path or "$", node))
        else:
            for i, x in enumerate(node):
                _tables(x, f"{path}[{i}]", out)
    elif isinstance(node, dict):
        if len(node) >= 2 and not any(isinstance(v, (list, dict)) for v in node.values()):
            out.append((1, path or "$", node))
        else:
            for k in _order(node):
                _tables(node[k], f"{path}.{k}" if path else k, out)
    return out


def test_tables_of_random_documents(spark):
    rng = random.Random(8)
    docs = []
    while len(docs) < 150:
        d = _random_json(rng)
        if isinstance(d, (dict, list)):
            docs.append(d if rng.random() < 0.6 else [{"b": 1, "a": i, **({"c": 2} if i else {})} for i in range(rng.randint(1, 4))])
    rows = [(i, rng.choice(["", " \n"]) + json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "plain"), (902, "{")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {r["id"]: (r["path"], r["table_kind"], r["rows"], r["columns"]) for r in J.table_shapes(df, ["id"], "body").collect()}
    want = {}
    for i, d in enumerate(docs):
        found = _tables(d, "", [])
        if not found:
            continue
        kind, path, table = min(found, key=lambda t: (t[0], -len(t[2])))
        if kind == 0:
            count = {}
            for row in table:
                for k in row:
                    count[k] = count.get(k, 0) + 1
            if count:
                want[i] = (path, "array_of_objects", len(table), sorted(count, key=lambda k: (-count[k], k.encode())))
        else:
            want[i] = (path, "object_of_scalars", len(table), ["Key", "Value"])
    assert got == want and len(want) > 60


def test_chart_of_a_cut_feed(spark):
    feed = {"chart": {"result": [{"meta": {"symbol": "LTH", "longName": "L"}, "timestamp": [1, 2, 3], "indicators": {"quote": [{"volume": [7, 8, 9], "close": [1.5, 2.5, 3.5], "open": [1, None, 3], "extra": [1, 2]}]}}], "error": {"code": [1, 2, 3]}}}
    whole = json.dumps(feed)
    rows = [(1, whole), (2, whole[: whole.index('"open"')]), (3, '{"timestamp": [1, 2]}'), (4, '{"close": [1, 2]}'), (5, None), (6, '{"timestamp": [1, 2], "name": "n", "Yield": [3, 4], "x": [[5, 6]]}')]
    got = J.chart_catalogs(spark.createDataFrame(rows, "id long, body string"), ["id"], "body").orderBy("id", "place").collect()
    assert [(r["id"], r["place"], r["series"], r["values"], r["label"]) for r in got] == [
        (1, 0, "close", [1.5, 2.5, 3.5], "LTH"), (1, 1, "volume", [7.0, 8.0, 9.0], "LTH"), (1, 2, "code", [1.0, 2.0, 3.0], "LTH"), (2, 0, "close", [1.5, 2.5, 3.5], "LTH"), (2, 1, "volume", [7.0, 8.0, 9.0], "LTH"), (6, 0, "yield", [3.0, 4.0], "n"), (6, 1, "", [5.0, 6.0], "n"),
    ]


# --- N16 -------------------------------------------------------------------------------------

PAGE = """<html><head><title> A  page </title><style>p {}</style></head><body class="main"><h1>One <b>big</b>
head</h1><h1> </h1><table id="t" class="a b"><tr><th>x<th>y<tr><td>1<td><table><tr><td>in</table><tr><td>2</table>
<ul class="l"><li class="i">one<li class="i  j">two</ul><ol></ol><script>var x = "<p class=i>";</script><noscript>none</noscript><p class="i j">end &amp; &#8217;</p></body></html>"""


def test_a_digest_as_a_whole(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<h1>" + "é" * 600 + "</h1>" + "word " * 300)], "id long, page string")
    got = {r["id"]: r["digest"] for r in H.digests(df, "id", "page", 600).collect()}
    assert got[1].split("\n") == [
        "--- HTML structure ---", "<title>: A page", "<h1>: One big head", "", "Tables:", '  <table id="t" class="a b"> (4 rows × 2 cols)', "  <table> (1 rows × 1 cols)", "", "Lists:", '  <ul class="l"> (2 items)', "  <ol> (0 items)",
        "", "Repeating element classes (iterator-eligible):", "  li.i: 2 occurrences", "", "--- Visible text (script/style excluded, truncated) ---", "One big head x y 1 in 2 one two end & ’", "",
    ]
    assert got[2] == got[3] == "--- HTML structure ---\n\n--- Visible text (script/style excluded, truncated) ---\n"
    assert "[...truncated at 1024 bytes]" in got[4] and got[4].endswith("[... structure summary consumed the budget; visible text elided]\n")
    cut = H.digests(df.filter("id = 1"), "id", "page", len(got[1].encode()) - 20).first()["digest"]
    assert "visible text truncated at" in cut and "full body text was 41 bytes" in cut
    assert {(r["selector"], r["n"]) for r in H.repeated_classes(H.page_elements(df, "id", "page"), "id").collect()} == {("li.i", 2)}


# --- selectors, page tables ------------------------------------------------------------------


def test_selectors():
    page = "<div class='a'><p>1<p>2<div><p>3</div></div><p class='a b' data-x=q>4</p><ul><li>x<li>y<ul><li>z</ul><li>w</ul><table><tr><td>5<td>6<tr><td>7</table><select><option>o<option>p</select>"
    find = lambda s, a=None: X.selected(page, s, a)
    assert find("div.a > p") == ["1", "2"] and find("div p") == ["1", "2", "3"] and find("div.a > div > p") == ["3"] and find("div > div.a") == []
    assert find("p.b, ul > li") == ["4", "x", "yz", "z", "w"] and find("p[data-x=q]", "class") == ["a b"] and find('p[data-x="q"].a.b') == ["4"]
    assert find("tr > td") == ["5", "6", "7"] and find("option") == ["o", "p"] and find("ul ul li") == ["z"] and find("div div.a p") == []
    assert find("tr > td:nth-child(2)") == ["6"] and find("table tr:nth-child(2) td:first-child") == ["7"] and find("li:nth-child(odd)") == ["x", "z", "w"] and find("li:nth-child( 2n + 1 ), ul li:nth-child(3)") == ["x", "z", "w"] and find("p:nth-child(-n+2)") == ["1", "2", "3", "4"]
    assert all(map(X.is_selector, ("li:nth-child(2)", "a:first-child b:nth-child(2n-1)", "a", "*", "#id", "a.b#c[d]", "a>b", "a > b c , d"))) and not any(map(X.is_selector, ("", "a:hover", "a + b", "> a", "a >", "a,", "a ~ b", "a[", "li:nth-child()", "li:last-child", "li:nth-child(x)")))


def test_tables_of_page_text():
    assert X.tables("Country Production\nAustralia 88000\n\nChile   49000\nUnited States 7\nend\nlast\n") == [[["Country", "Production"], ["Australia", "88000"], ["Chile", "49000"]]]
    assert X.tables("a\tb\n1 2\nx y z\np q r") == [[["a", "b"], ["1", "2"]], [["x", "y", "z"], ["p", "q", "r"]]]
    assert X.spot_value(["", "a 1\nb 2"], [2, 0, 1, 1]) == ("2", None) and X.spot_value(["a 1\nb 2"], [0, 0, 0, 0])[1] == X.spot_value(["a 1\nb 2"], [1, 0, -1, 0])[1] == X.spot_value(None, [1, 0, 0, 0])[1] == "no such cell"


# --- N6, PF7, N21 ----------------------------------------------------------------------------


def test_references(spark):
    cases = {
        "It&#8217;s &#x41;&#X1f600;": "It’s A😀", "&amp;lt; &#38;lt;": "&lt; &lt;", "&nope; &#; &#x; &#xZZ; & &;": "&nope; &#; &#x; &#xZZ; & &;", "&#xD800;&#55296;&#1114112;": "&#xD800;&#55296;&#1114112;", "&#12345678;": "&#12345678;",
        "&nbsp;&hellip;&trade;": " …™", "": "", "&lt;&lt;": "<<", "x&#9;y": "x\ty",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.decoded(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases
    assert _one(spark, T.decoded(F.lit(None).cast("string"))) is None


def test_names_between_quotes_are_found_as_like_finds_them(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choices('ab"_,', weights=[3, 3, 4, 1, 1], k=rng.randint(0, 30)))) for i in range(150)] + [(900, None), (901, '"')]
    names = sorted({"".join(rng.choices("ab_", k=rng.randint(1, 5))) for _ in range(60)})
    t, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(x,) for x in names], "name string")
    want = {tuple(r) for r in t.join(n, F.expr("""t LIKE concat('%"', name, '"%')""")).select("id", "name").collect()}
    assert {tuple(r) for r in T.quoted_names(t, "id", "t", n, "name").collect()} == want and len(want) > 100
    plan = T.quoted_names(t, "id", "t", n, "name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 1  # the one row of bounds


def test_near_misses_equal_all_pairs(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(120)})
    allowed = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(50)})

    def near(a, b):
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        s, l = sorted((a, b), key=len)  # noqa: E741
        return len(l) == len(s) + 1 and any(l[:k] + l[k + 1 :] == s for k in range(len(l)))

    want = {w: c[0] for w in words if len(c := [a for a in allowed if near(w, a)]) == 1}
    got = T.near_misses(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(a,) for a in allowed], "a string"), "a")
    assert {r["w"]: r["suggestion"] for r in got.collect()} == want and want
