"""Queries of what is shown: previews, formats, summaries, orders, tables, charts, page framing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import dashboard as D
from ..operators import documents as DOC
from ..operators import extraction as X
from ..operators import presentation as P
from ..sources import bridge as B
from ..sources.bridge import oracle
from . import catalog_recipes as _before  # the queries before these
from .catalog import PAGES, query

catalog = _before.catalog

_CUT = "(SELECT max(k) FROM (SELECT unnest(range(0, {n} + 1)) AS k) WHERE strlen(left(body, CAST(k AS BIGINT))) <= {n})"


@query(oracle("docs", f"SELECT id, CASE WHEN strlen(body) <= 90 THEN body ELSE left(body, CAST({_CUT.format(n=90)} AS BIGINT)) || '[...truncated at 90 bytes]' END AS cut, trim(regexp_replace(left(body, 300), '\\s+', ' ', 'g')) AS flat FROM docs"))
def truncated_texts(spark, d):
    return B.documents(spark, d).select("id", P.truncated(F.col("body"), 90).alias("cut"), P.collapsed(F.substring("body", 1, 300)).alias("flat"))


@query(oracle("docs", "SELECT id, CASE id % 4 WHEN 2 THEN '' WHEN 1 THEN left(body, 131072) ELSE left(body, 32768) END AS body, CASE id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'data_feed' WHEN 2 THEN 'filing' ELSE 'transcript' END AS kind, 'https://x.org/' || id AS dedup_key, 'host' || (id % 7) || '#recipe:r@v3' AS source_id FROM (SELECT id, repeat(CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END, CAST(id % 3 AS INT) * 70000) AS body FROM docs)"))
def fetched_documents(spark, d):
    """Bodies bounded by their kind of content, and the document made of each fetch."""
    i = F.col("id")
    fetches = B.dealt(B.documents(spark, d), "id").select(
        "id", F.concat(F.lit("host"), i % 7).alias("source_id"), F.lit("r").alias("recipe_id"), F.lit(3).alias("version"), F.concat(F.lit("https://x.org/"), i).alias("source_url"), F.col("mime").alias("content_type"),
        F.repeat(F.when(i % 2 == 0, "a").otherwise("b"), (i % 3 * 70000).cast("int")).alias("body"), F.array(F.lit("t")).alias("topics"), F.lit("2024-01-01").alias("fetched_at"),
    )
    made = P.fetched_documents(fetches)
    return made.select(F.regexp_extract("dedup_key", "([0-9]+)$", 1).cast("long").alias("id"), "body", "kind", "dedup_key", "source_id")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'pdf' ELSE 'other' END AS format FROM pages")
def sniffed_formats(spark, d):
    i = F.col("page_id")
    body = F.when(i % 4 == 0, F.concat(F.lit("﻿ \n"), "html")).when(i % 4 == 1, F.concat(F.lit(" [\""), "url", F.lit("\"]"))).when(i % 4 == 2, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.concat(F.lit("x"), "html"))
    return B.table(spark, d, "pages").select("page_id", P.sniffed(body).alias("format"))


@query(oracle("docs", "SELECT id, CASE WHEN k < 0 THEN body ELSE left(body, k) || chr(65533) END AS excerpt FROM (SELECT id, left(body, 20) || '€' AS body, -1 AS k FROM docs WHERE strlen(left(body, 20)) <= 61 UNION ALL SELECT id, left(body, 20) || '€' AS body, 20 AS k FROM docs WHERE strlen(left(body, 20)) > 61)"))
def lossy_excerpts(spark, d):
    """Bytes cut within their last character: a replacement character if it fits, all of it if nothing is cut."""
    t = F.concat(F.substring("body", 1, 20), F.lit("€"))
    return B.documents(spark, d).select("id", P.lossy_excerpt(F.encode(t, "UTF-8"), 64).alias("excerpt"))


@query("SELECT event_id, 'rate-limited; ' || CASE WHEN event_id % 5 = 0 THEN 'no Retry-After provided' WHEN s >= 3600 THEN 'retry after ' || (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN 'retry after ' || (s // 60) || 'm ' || (s % 60) || 's' ELSE 'retry after ' || s || 's' END AS said FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def retry_texts(spark, d):
    s = F.col("event_id") * 7 % 9000
    return B.table(spark, d, "events").select("event_id", P.retry_after(F.when(F.col("event_id") % 5 != 0, s)).alias("said"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 3 THEN '@v' ELSE lower(n_name) END AS provider, CASE n_nationkey % 4 WHEN 0 THEN 'v' || n_nationkey || '@x' END AS version FROM nation")
def classifier_ids(spark, d):
    k, name = F.col("n_nationkey"), F.lower("n_name")
    stored = F.when(k % 4 == 0, F.concat(name, F.lit("@v"), k, F.lit("@x"))).when(k % 4 == 1, F.concat(name, F.lit("@"))).when(k % 4 == 2, name).otherwise(F.lit("@v"))
    return B.table(spark, d, "nation").select(k.alias("id"), P.classifier_id(stored).alias("p")).select("id", "p.provider", "p.version")


_SHOWN = ("observation", "event", "entity", "relation", "document", "assertion")


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'production: ' || event_id || ' t' ELSE 'production: ' || event_id END WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN event_type ELSE 'Headline ' || event_id END
  WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'mine' ELSE 'Mine ' || event_id || ' (mine)' END WHEN 3 THEN CASE WHEN event_id % 4 = 1 THEN 'owns' ELSE 'owns: a' || event_id || ' → b' END WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'filing' ELSE ' T ' END
  ELSE CASE WHEN event_id % 4 = 1 THEN '(unknown) asserted' ELSE 'agency:x denied' END END AS line FROM events""")
def record_summaries(spark, d):
    i = F.col("event_id")
    odd = i % 4 < 2
    c = (
        F.when(i % 6 == 0, F.to_json(F.struct(F.lit("production").alias("metric"), i.alias("value"), F.when(odd, "t").alias("unit"))))
        .when(i % 6 == 1, F.to_json(F.struct(F.when(~odd, F.concat(F.lit("Headline "), i)).alias("headline"), "event_type")))
        .when(i % 6 == 2, F.to_json(F.struct(F.when(~odd, F.concat(F.lit("Mine "), i)).alias("canonical_name"), F.lit("mine").alias("kind"))))
        .when(i % 6 == 3, F.to_json(F.struct(F.lit("owns").alias("kind"), F.concat(F.lit("a"), i).alias("from"), F.when(~odd, "b").alias("to"))))
        .when(i % 6 == 4, F.to_json(F.struct(F.when(odd, " ").otherwise(" T ").alias("title"), F.lit("filing").alias("kind"))))
        .otherwise(F.to_json(F.struct(F.when(~odd, "agency:x").alias("claimant"), F.when(~odd, "denied").alias("stance"))))
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), (i % 6 + 1).cast("int"))
    return B.table(spark, d, "events").select(i.alias("id"), P.summary(kind, c).alias("line"))


@query("SELECT c_custkey AS id, c_custkey % 3 = 0 OR contains(lower(c_name), '00') AS fits, lower(c_mktsegment) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%house%' AS any_of FROM customer")
def matching_texts(spark, d):
    q = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.lit(" 00 "))
    low = F.lower("c_mktsegment")
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.matches(F.col("c_name"), q).alias("fits"), (low.like("%auto%") | low.like("%house%")).alias("any_of"))


@query("SELECT host, tone, row_number() OVER (ORDER BY CASE tone WHEN 'blocked' THEN 0 WHEN 'recovering' THEN 1 ELSE 2 END, host) AS place FROM (SELECT 'h' || s_suppkey AS host, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 THEN 'clean' WHEN s_suppkey % 4 = 1 THEN 'blocked' ELSE 'recovering' END AS tone FROM supplier)")
def host_order(spark, d):
    k = F.col("s_suppkey")
    hosts = B.table(spark, d, "supplier").select(F.concat(F.lit("h"), k).alias("host"), (k % 3).alias("failures"), F.when(k % 4 == 1, 30).otherwise(0).alias("wait"))
    w = D.Window.orderBy(F.when(F.col("tone") == "blocked", 0).when(F.col("tone") == "recovering", 1).otherwise(2), "host")
    return P.backoff_order(hosts).withColumn("place", F.row_number().over(w).cast("long")).select("host", "tone", "place")


@query(oracle("claims", "SELECT CASE WHEN id % 4 = 0 THEN '(unknown)' ELSE kind END AS kind, count(*) AS n FROM claims GROUP BY 1"))
def kinds_of_records(spark, d):
    blank = F.when(F.col("id") % 4 == 0, F.when(F.col("id") % 8 == 0, F.lit("  "))).otherwise(F.col("kind"))
    return D.by_kind(B.claims(spark, d).select(blank.alias("kind")), "kind")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'a' || chr(10) || 'b' || chr(10) || o_orderkey END AS said FROM orders")
def user_texts(spark, d):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("a\r\nb\r"), F.when(k % 3 == 0, F.lit("‮")).otherwise(""), k)
    return B.table(spark, d, "orders").select(k.alias("id"), V.user_text(t).alias("said"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'short' ELSE left('/' || repeat('path', 30), 79) || '…' END AS path FROM supplier")
def shortened_paths(spark, d):
    p = F.when(F.col("s_suppkey") % 2 == 0, F.lit("short")).otherwise(F.concat(F.lit("/"), F.repeat(F.lit("path"), 30)))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.shortened(p).alias("path"))


@query(oracle("observations", "SELECT metric, seq, valid_at, regexp_extract(source_id, '^(.*)#recipe:', 1) AS src, CAST(regexp_extract(source_id, '@v([0-9]+)$', 1) AS INT) AS version, row_number() OVER (PARTITION BY metric ORDER BY valid_at DESC, seq DESC, part DESC) AS place FROM observations").replace("seq, valid_at,", "seq, CAST(CAST(valid_at AS DATE) AS VARCHAR) AS day,"))
def observation_rows(spark, d):
    """Rows of a metric's detail view: newest first, with what the source id says."""
    from ..functions.keys import with_source_key

    rows = with_source_key(B.observations(spark, d)).withColumn("day", F.col("valid_at").cast("date"))
    placed = P.placed(rows, "metric", "day", [F.desc("valid_at"), F.desc("seq"), F.desc("part")])
    return placed.select("metric", "seq", F.col("day").cast("string").alias("day"), F.col("src_base").alias("src"), F.col("recipe_version").alias("version"), "place")


@query("SELECT o_orderpriority AS kind, array_to_string(list_slice(list(v ORDER BY f, v), 1, 8), '|') AS samples FROM (SELECT o_orderpriority, trim(o_clerk) AS v, min(o_orderkey) AS f FROM (SELECT *, ' c' || (o_custkey % 30) AS o_clerk FROM orders WHERE o_custkey % 5 <> 0) GROUP BY 1, 2) GROUP BY 1")
def deduped_samples(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.when(F.col("o_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" c"), F.col("o_custkey") % 30)).alias("v"))
    return P.samples(o, "kind", "v", ["o_orderkey"]).select("kind", F.array_join("samples", "|").alias("samples"))


@query("WITH k AS (SELECT user_id % 20 AS t, unnest(CASE event_id % 3 WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['a'] ELSE ['c', 'a', 'd'] END) AS name FROM events WHERE event_id % 7 <> 0), s AS (SELECT user_id % 20 AS t, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1 HAVING count(*) >= 2) SELECT t, name, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, name) AS place FROM (SELECT k.t, name, count(*) AS n FROM k JOIN s ON s.t = k.t GROUP BY 1, 2)")
def table_columns(spark, d):
    i = F.col("event_id")
    j = F.when(i % 7 == 0, F.lit("[1]")).when(i % 3 == 0, F.lit('{"b":1,"a":2}')).when(i % 3 == 1, F.lit('{"a":1}')).otherwise(F.lit('{"c":1,"a":2,"d":3}'))
    return P.table_columns(B.table(spark, d, "events").select((F.col("user_id") % 20).alias("t"), j.alias("j")), "t", "j").select("t", "name", "n", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)")
def sorted_table(spark, d):
    """Numbers going down, with missing ones first."""
    k = F.col("c_custkey")
    rows = B.table(spark, d, "customer").select(k.alias("id"), F.when(k % 6 == 0, F.lit(" ")).otherwise(F.col("c_acctbal").cast("string")).alias("v"))
    shown = P.sorted_rows(rows, "v", "id", descending=True)
    w = D.Window.orderBy(F.desc_nulls_first(F.nullif(F.trim("v"), F.lit("")).try_cast("double")), "id")
    return shown.select("id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT user_id AS k, min_by(event_id, struct_pack(a := abs(event_id - 5000), b := event_id)) AS nearest FROM events GROUP BY 1")
def nearest_points(spark, d):
    return P.nearest(B.table(spark, d, "events"), "user_id", "event_id", "event_id", F.lit(5000)).select(F.col("user_id").alias("k"), "nearest")


@query("SELECT event_type, count(*) AS n, CAST(sum(i) AS BIGINT) AS spots FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE i % CAST(ceil(c / 100.0) AS BIGINT) = 0 OR i = c - 1 GROUP BY 1")
def strided_series(spark, d):
    w = D.Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = B.table(spark, d, "events").withColumn("spot", F.row_number().over(w) - 1)
    return P.strided(e, "event_type", ["ts", "event_id"], 100).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("spot").alias("spots"))


@query(oracle("observations", "SELECT metric, CAST(i AS INT) AS tick, round(lo + (hi - lo) * i / 4, 4) AS spot FROM (SELECT metric, min(value) - (max(value) - min(value)) * 0.05 AS lo, max(value) + (max(value) - min(value)) * 0.05 AS hi FROM observations GROUP BY 1), (SELECT unnest(range(0, 5)) AS i)"))
def chart_ticks(spark, d):
    return P.ticks(D.chart_domain(B.observations(spark, d), "metric", "value")).select("metric", "tick", F.round("at", 4).alias("spot"))


@query(oracle("plans recipes", "SELECT plan_id, count(DISTINCT slot) AS covered FROM recipes GROUP BY 1"))
def covered_expectations(spark, d):
    expected = B.plans(spark, d).select("plan_id", F.lit("metric").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("idx"), F.col("topic").alias("label"))
    bound = B.recipes(spark, d).select("plan_id", F.lit("metric").alias("bucket"), F.col("slot").cast("long").alias("idx"), "recipe_id")
    return D.coverage(expected, bound).filter(F.size("recipes") > 0).groupBy("plan_id").agg(F.count("*").alias("covered"))


@query("WITH " + PAGES + r""", f AS (SELECT doc, page_no, CASE WHEN page_no % 2 = 0 THEN '[PDF page ' || (page_no + 1) || '] (no table detected)' ELSE '[PDF page ' || (page_no + 1) || ', table 0] (2 rows × 2 cols)' || chr(10) || '  row 0 (col 0..1): "name"  "tons"' || chr(10) || '  row 1 (col 0..1): "a\"b"  "' || page_no || '"' END AS t FROM p WHERE page_no <> 2),
g AS (SELECT *, page_no - lag(page_no) OVER (PARTITION BY doc ORDER BY page_no) - 1 AS gap FROM f) SELECT doc, string_agg(CASE WHEN gap > 0 THEN '[... ' || gap || ' pages skipped (low topic relevance) ...]' || chr(10) || chr(10) ELSE '' END || t, chr(10) || chr(10) ORDER BY page_no) AS text FROM g GROUP BY 1""")
def framed_pages(spark, d):
    """Pages with their tables written out, and marks for the pages left out."""
    w = D.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("page_no"))
    tables = F.when(F.col("page_no") % 2 == 0, F.expr("array()").cast("array<array<array<string>>>")).otherwise(F.array(F.array(F.array(F.lit("name"), F.lit("tons")), F.array(F.lit('a"b'), F.col("page_no").cast("string")))))
    return P.emitted(p.filter("page_no <> 2").withColumn("t", P.framed_page(F.col("page_no") + 1, tables)), "doc", "page_no", "t")


# --- markup, with SQL over the one form that the pages have ---------------------------------

_SIZE = "strlen(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
_A = "<a(?:[ \\t\\n/][^>]*)?>(.*?)(?:</a[^>]*>|$)"
_TOKEN = " OR ".join(f"contains(path, '{t}')" for t in DOC.INDEX_TOKENS)
SIGNALS = f"""h AS (SELECT page_id, lower(CASE WHEN regexp_extract(lower(url), '://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(lower(url), '://[^/]*(/.*)$', 1) END) AS path, regexp_replace(html, '<(?:script.*?</script>|style.*?</style>|!--.*?-->)', '', 'gis') AS h FROM pages),
z AS (SELECT page_id, {_TOKEN} AS token, CAST(coalesce(list_sum(list_transform(regexp_extract_all(h, '{_A}', 1, 'is'), lambda x: {_SIZE.format("x")})), 0) AS BIGINT) AS anchor, CAST({_SIZE.format(f"regexp_replace(h, '{_A}', '<>', 'gis')")} AS BIGINT) AS other FROM h),
signals AS (SELECT page_id, anchor, other, CASE WHEN other < {DOC.PROSE_FLOOR} AND NOT token AND anchor = 0 THEN 'unknown' WHEN other < {DOC.PROSE_FLOOR} THEN 'index' WHEN token OR anchor / (anchor + other) >= {DOC.DENSITY} THEN 'index' ELSE 'article' END AS signal FROM z)"""
catalog._oracles["index_pages"] = f"WITH {SIGNALS} SELECT * FROM signals"
catalog._oracles["culled_claims"] = oracle("claims", "SELECT CASE WHEN signal IS NULL THEN 'unrouted' WHEN signal = 'index' THEN 'culled' ELSE 'kept_' || signal END AS action, count(*) AS n FROM claims c LEFT JOIN l ON l.s = regexp_extract(c.source_id, '^(.*)#recipe:', 1) GROUP BY 1", SIGNALS + ", l AS (SELECT 'host' || (page_id % 15) AS s, max_by(signal, page_id) AS signal FROM signals GROUP BY 1)")
catalog._oracles["selected_markup"] = "SELECT page_id, trim(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&amp;', '&')) AS title, regexp_extract(html, '(?s)<nav>.*?<a href=\"([^\"]*)\"', 1) AS first_link, CAST(NULL AS VARCHAR) AS error FROM pages"


@query(f"WITH {SIGNALS} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN NULL ELSE signal = 'index' END AS refused FROM signals")
def index_gate(spark, d):
    """Fetched pages refused as index pages; recipes with an iterator are never asked."""
    pages = DOC.with_index_signal(B.table(spark, d, "pages").withColumn("mime", F.lit("text/html")), "html", "mime", "url")
    return pages.select("page_id", F.when(F.col("page_id") % 2 == 1, F.col("signal") == "index").alias("refused"))
