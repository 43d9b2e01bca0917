"""Queries of listings and small changes: newest rows, tiles, previews, counters, look-ups, statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, dml
from ..operators import documents as DOC
from ..operators import entities as E
from ..operators import presentation as P
from ..sources import bridge as B
from ..sources import store
from ..sources.bridge import oracle
from . import catalog_shapes as _before  # the queries before these
from .catalog import query

catalog = _before.catalog

_TOP = "SELECT '{n}' AS listing, CAST({id} AS VARCHAR) AS id, row_number() OVER (ORDER BY {by} DESC, {id} DESC) AS place FROM {t} QUALIFY row_number() OVER (ORDER BY {by} DESC, {id} DESC) <= {k}"
_LISTS = (("plans", "plan_id", "seq", "plans"), ("recipes", "recipe_id", "version", "recipes"), ("attempts", "seq", "attempted_at", "att"), ("outcomes", "id", "attempted_at", "outcomes"), ("runs", "run_id", "last_at", "runs"))


@query(oracle("plans recipes attempts outcomes", " UNION ALL ".join(f"SELECT * FROM ({_TOP.format(n=n, id=i, by=by, t=t, k=P.LISTED[n])})" for n, i, by, t in _LISTS), "runs AS (SELECT run_id, max(attempted_at) AS last_at FROM outcomes GROUP BY 1), att AS (SELECT DISTINCT seq, attempted_at FROM attempts)"))
def newest_rows(spark, d):
    """The newest plans, recipes, attempts, outcomes and runs, as many as their listings show."""
    outcomes = B.outcomes(spark, d)
    rows = {"plans": B.plans(spark, d), "recipes": B.recipes(spark, d), "attempts": B.attempts(spark, d).select("seq", "attempted_at").distinct(), "outcomes": outcomes, "runs": outcomes.groupBy("run_id").agg(F.max("attempted_at").alias("last_at"))}
    out = None
    for n, i, by, _ in _LISTS:
        part = P.newest(rows[n], n, by, i).select(F.lit(n).alias("listing"), F.col(i).cast("string").alias("id"), F.col("place").cast("long").alias("place"))
        out = part if out is None else out.union(part)
    return out


_SAID = "s AS (SELECT event_id AS id, ts AS observed_at, user_id % 100 AS e, event_id % 4 AS k, event_id % 5 = 0 AS empty FROM events WHERE event_id % 7 <> 0)"


@query("WITH " + _SAID + ", t AS (SELECT 'mine:' || e AS entity_id, 'k' || k AS key, max_by('v' || id, struct_pack(a := observed_at, b := id)) AS value, max(struct_pack(a := observed_at, b := id)) AS o FROM s WHERE NOT empty GROUP BY 1, 2) SELECT entity_id, key, value, row_number() OVER (PARTITION BY entity_id ORDER BY o DESC) - 1 AS place FROM t")
def entity_tiles(spark, d):
    """What was last said of each attribute of an entity, the newest attribute first."""
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, "relation").otherwise("entity_attribute")
    value = F.when(i % 5 == 0, F.lit('{"kind":"text","value":""}')).otherwise(F.concat(F.lit('{"kind":"text","value":"v'), i, F.lit('"}')))
    content = F.concat(F.lit('{"asserted_kind":"'), kind, F.lit('","entity_id":"mine:'), F.col("user_id") % 100, F.lit('","key":"k'), i % 4, F.lit('","value":'), value, F.lit("}"))
    said = B.table(spark, d, "events").select(i.alias("id"), F.col("ts").alias("observed_at"), content.alias("content"))
    return P.entity_tiles(said).withColumn("place", F.col("place").cast("long"))


@query(oracle("entities", "SELECT entity_id, seq, old_tier, new_tier FROM (SELECT *, rank() OVER (ORDER BY seq DESC) AS r FROM (SELECT entity_id, seq, CAST(old_tier AS INT) AS old_tier, CAST(t AS INT) AS new_tier FROM (SELECT *, max(t) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_tier FROM (SELECT *, CASE license WHEN 'extracted' THEN 3 WHEN 'classifier-emitted' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS t FROM (SELECT 'c:' || (seq % 701) AS entity_id, seq, license FROM entities))) WHERE old_tier IS NOT NULL AND t > old_tier)) WHERE r <= 50"))
def refresh_history(spark, d):
    """The log of raised tiers, cut at its fifty newest entries."""
    log = E.refresh_log(B.entities(spark, d).withColumn("entity_id", F.concat(F.lit("c:"), F.col("seq") % 701)))
    return audit.trimmed(log, "seq", 50).select("entity_id", "seq", "old_tier", "new_tier")


@query("WITH x AS (SELECT c_custkey AS seq, c_custkey % 120 AS e FROM customer), f AS (SELECT e, min(seq) AS seq FROM x GROUP BY 1) SELECT CASE WHEN e % 10 = 9 THEN 'error' WHEN f.seq IS NULL THEN 'skipped' WHEN e % 4 = 0 THEN 'materialized' WHEN e % 4 = 1 THEN 'refreshed' ELSE 'skipped' END AS outcome, count(*) AS n FROM x LEFT JOIN f USING (e, seq) GROUP BY 1")
def exemplar_counters(spark, d):
    """What becomes of exemplars beside entities of no, a lower, the same and a higher tier."""
    k = F.col("c_custkey")
    e = k % 120
    name = F.concat(F.when(e % 10 == 9, F.lit("no id ")).otherwise(F.lit("mine:")), e)
    rows = B.table(spark, d, "customer").select(name.alias("entity_id"), F.lit("classifier-emitted").alias("license"), k.alias("seq"))
    there = B.table(spark, d, "customer").filter(e % 4 > 0).select(name.alias("entity_id"), F.when(e % 4 == 1, "unknown").when(e % 4 == 2, "classifier-emitted").otherwise("extracted").alias("license"))
    return E.materialized(rows, there).groupBy("outcome").agg(F.count("*").alias("n"))


@query(oracle("claims", """SELECT c.id, kind AS content_kind, CASE (id % 15) % 3 WHEN 0 THEN '/' || repeat('Path', 19) || '/q' || '…' WHEN 1 THEN '/' ELSE 'no host ' || (id % 15) END AS source_path, 'index' AS signal FROM claims c WHERE id % 15 < 9 ORDER BY observed_at DESC, id DESC LIMIT 50"""))
def cull_previews(spark, d):
    """The newest claims that a cull would take: the latest page of a source decides, and hosts are not shown."""
    c = B.claims(spark, d).select("id", F.concat(F.lit("s"), F.col("id") % 15).alias("source_id"), F.col("kind").alias("content_kind"), "observed_at")
    s = F.col("id")
    url = F.when(s % 3 == 0, F.concat(F.lit("https://Host.org/"), F.repeat(F.lit("Path"), 19), F.lit("/q=12345"))).when(s % 3 == 1, F.lit("https://host.org")).otherwise(F.concat(F.lit("no host "), s))
    sources = c.select((F.col("id") % 15).alias("id")).distinct()
    pages = sources.select(F.concat(F.lit("s"), s).alias("source_id"), url.alias("source_url"), F.when(s < 9, "index").otherwise("article").alias("signal"), F.lit(2).alias("observed_at"), s.alias("id"))
    older = pages.withColumn("observed_at", F.lit(1)).withColumn("signal", F.when(F.col("signal") == "index", "article").otherwise("index"))
    return DOC.cull_preview(c, pages.union(older))


@query(oracle("claims entities", "SELECT 'claim' AS what, CAST(id AS VARCHAR) AS id, kind FROM claims WHERE id = (SELECT max(id) FROM claims) UNION ALL SELECT 'entity', CAST(seq AS VARCHAR), kind FROM entities WHERE entity_id = 'company:7'"))
def found_rows(spark, d):
    """Rows by their id and by their business key; a key that none has is an error (in the tests)."""
    c, e = B.claims(spark, d), B.entities(spark, d)
    last = c.agg(F.max("id").alias("id")).first()["id"]
    shown = lambda df, what, i: df.select(F.lit(what).alias("what"), F.col(i).cast("string").alias("id"), "kind")
    return shown(store.found(c, "id", last), "claim", "id").union(shown(store.found(e, "entity_id", "company:7"), "entity", "seq"))


@query(oracle("plans", "SELECT plan_id, CASE WHEN topic = 'asia' THEN 'rejected' ELSE status END AS status, CASE WHEN topic = 'asia' THEN 'too broad' END AS reason FROM plans"))
def plans_after_rejection(spark, d):
    """One plan's status and reason set, all others as they were."""
    return dml.updated(B.plans(spark, d).withColumn("reason", F.lit(None).cast("string")), "topic = 'asia'", status="rejected", reason="too broad").select("plan_id", "status", "reason")


@query(oracle("claims", "SELECT CASE WHEN id % 2 = 0 THEN '/a/B?c=' || id ELSE 'plain ' || id END AS path, count(*) AS n FROM claims GROUP BY 1"))
def hostless_paths(spark, d):
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://x.org:80/a/B?c="), "id")).otherwise(F.concat(F.lit("plain "), "id"))
    return B.claims(spark, d).groupBy(T.hostless(url).alias("path")).agg(F.count("*").alias("n"))
