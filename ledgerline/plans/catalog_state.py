"""Queries of state: typed look-ups, routing, registries, clean-up, plan checks, lineages, promoted rows, drafts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, claims as C, dml
from ..operators import documents as DOC
from ..operators import state as S
from ..sources import bridge as B
from ..sources import store
from ..sources.bridge import oracle
from . import catalog_views as _before  # the queries before these
from .catalog import HASHES, _facts, query
from .catalog_store import _records

catalog = _before.catalog


@query(oracle("claims", "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN (id - 1) || ':event:extraction' ELSE '' END AS parents FROM claims"))
def rebuilt_provenance(spark, d):
    r = _records(spark, d)
    back = store.rebuilt(r.drop(*store.CHILDREN), store.exploded(r))
    return back.select("id", F.array_join(F.transform("derived_from", lambda e: F.concat_ws(":", e["parent_id"], e["parent_type"], e["role"])), ",").alias("parents"))


@query(oracle("claims entities", "SELECT record_type, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, 'event' AS record_type FROM claims UNION ALL SELECT seq, 'entity' FROM entities WHERE seq NOT IN (SELECT id FROM claims)) GROUP BY 1"))
def fetched_by_id(spark, d):
    """Rows of ids, whatever their type: the first table that has an id gives it."""
    claims = B.claims(spark, d).select("id", "kind")
    entities = B.entities(spark, d).select(F.col("seq").alias("id"), "canonical_name")
    ids = claims.select("id").union(entities.select("id")).distinct()
    return store.fetched(ids, {"event": claims, "entity": entities}).groupBy("record_type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(oracle("claims entities", "SELECT CASE kind WHEN 'click' THEN 'event' WHEN 'error' THEN 'relation' ELSE 'observation' END AS record_type, count(*) AS n FROM claims GROUP BY 1 UNION ALL SELECT 'entity', count(DISTINCT entity_id) FROM entities"))
def routed_records(spark, d):
    e = B.entities(spark, d).withColumn("record_type", F.lit("entity"))
    t = F.when(F.col("kind") == "click", "event").when(F.col("kind") == "error", "relation").otherwise("observation")
    tables = S.routed(e.unionByName(B.claims(spark, d).select("id", t.alias("record_type")), allowMissingColumns=True))
    n = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("record_type"), "n") for name, df in tables.items()]
    out = n[0]
    for x in n[1:]:
        out = out.union(x)
    return out.filter("n > 0")


@query(oracle("claims", "SELECT t, count(*) AS n FROM (SELECT 'entities' AS t, id, unnest([rel_from, rel_to]) AS v FROM claims UNION ALL SELECT 'topics', id, unnest([kind, 'lithium']) FROM claims UNION ALL SELECT 'places', id, 'CL' FROM claims) WHERE id % 3 <> 0 GROUP BY 1 UNION ALL SELECT 'derived_from', count(*) FROM claims WHERE id % 2 = 0 AND id % 3 <> 0 AND NOT (id - 1) % 3 = 0"))
def children_left(spark, d):
    """Junction rows and edges after the records with ids divisible by three, and events of such ids, are gone."""
    r = _records(spark, d)
    own = r.filter(F.col("id").cast("long") % 3 == 0).select("id", "record_type")
    events = r.filter(F.col("id").cast("long") % 3 == 0).select("id", F.lit("event").alias("record_type"))
    after = S.without_children(store.exploded(r), own.union(events))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(c).alias("t"), "n") for c, t in after.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(oracle("claims", "SELECT CAST(id AS VARCHAR) AS child_id FROM claims WHERE id % 2 = 0 AND (id - 1) IN (SELECT id FROM claims WHERE kind <> 'click')"))
def edges_with_parents(spark, d):
    known = B.claims(spark, d).filter("kind <> 'click'").select(F.col("id").cast("string").alias("id"))
    return dml.without_dangling(store.exploded(_records(spark, d))["derived_from"], known).select("child_id")


@query(oracle("claims", "SELECT id FROM claims WHERE id NOT IN (SELECT id FROM claims WHERE kind = 'click')"))
def new_claims(spark, d):
    """What does not exist yet, once each though it comes twice."""
    c = B.claims(spark, d).select("id", "kind")
    return dml.missing(c.union(c), c.filter("kind = 'click'"), ["id"]).select("id")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'm' || (n_nationkey % 2) END AS metric, 's' || (n_nationkey % 5) AS source_id, CAST(max(n_nationkey) AS BIGINT) AS id, CAST(min(n_nationkey) AS BIGINT) AS created_at, row_number() OVER (ORDER BY min(n_nationkey)) AS place FROM nation GROUP BY 1, 2")
def registry_entries(spark, d):
    """Entries put over a registry by a key in which null equals null, in the order in which they came."""
    k = F.col("n_nationkey").cast("long")
    n = B.table(spark, d, "nation").select(F.concat(F.lit("s"), k % 5).alias("source_id"), F.when(k % 3 != 0, F.concat(F.lit("m"), k % 2)).alias("metric"), F.lit(None).cast("string").alias("topic"), k.alias("id"), k.alias("created_at"))
    w = audit.Window.orderBy("created_at", "id")
    done = S.registry_upserted(n.filter("id < 12"), n.filter("id >= 12"), "id")
    return done.select("metric", "source_id", "id", "created_at", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT 'agency:document' AS source_id, 1 AS quorum UNION ALL SELECT 's' || n_nationkey, 2 FROM nation")
def seeded_registries(spark, d):
    """An empty registry takes the default entry, another one stays as it is."""
    schema = "source_id string, metric string, topic string, quorum int"
    seed = spark.createDataFrame([S.SEED], schema)
    full = B.table(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("source_id"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("topic"), F.lit(2).alias("quorum"))
    return dml.seeded(spark.createDataFrame([], schema), seed).union(dml.seeded(full, seed)).select("source_id", "quorum")


@query(oracle("recipes", "SELECT plan_id, slot, version FROM recipes WHERE NOT (slot = 3 AND version = 1)"))
def cleared_feedback(spark, d):
    r = B.recipes(spark, d).select("plan_id", "slot", "version")
    return dml.deleted(r, r.filter("slot = 3 AND version = 1"), ["plan_id", "slot", "version"])


_ENT = "e AS (SELECT c_custkey AS id, 'mine:' || (c_custkey % 40) AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'plan:p9#entity_exemplar' ELSE 'plan:p1#entity_exemplar' END AS source_id FROM customer), h AS (SELECT 'mine:' || i AS entity_id, min(i % 4) AS heir FROM (SELECT unnest(range(0, 20)) AS i) GROUP BY 1)"


def _cleanup(spark, d):
    k = F.col("c_custkey")
    entities = B.table(spark, d, "customer").select(k.cast("string").alias("id"), F.concat(F.lit("mine:"), k % 40).alias("entity_id"), F.when(k % 3 == 0, F.lit("plan:p9#entity_exemplar")).otherwise(F.lit("plan:p1#entity_exemplar")).alias("source_id"))
    plans = spark.range(5).select(F.concat(F.lit("p"), "id").alias("plan_id"), F.when(F.col("id") == 4, "rejected").otherwise("accepted").alias("status"), F.col("id").alias("created_at"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat(F.lit("mine:"), (j * 4 + F.col("id")).cast("string"))).alias("ids"))
    plans = plans.withColumn("ids", F.filter("ids", lambda x: F.substring(x, 6, 9).cast("int") < 20))
    own = entities.select("id", F.lit("entity").alias("record_type"), F.array("entity_id").alias("entities"), F.array(F.lit("CL")).alias("places"), F.array().cast("array<string>").alias("topics"), F.array(F.struct(F.lit("x").alias("parent_id"), F.lit("plan").alias("parent_type"), F.lit("exemplar").alias("role"))).alias("derived_from"))
    return S.plan_cleanup(entities, plans, store.exploded(own), "p9")


@query("WITH " + _ENT + " SELECT e.id AS id, CASE WHEN source_id = 'plan:p9#entity_exemplar' THEN 'plan:p' || heir || '#entity_exemplar' ELSE source_id END AS source_id FROM e LEFT JOIN h USING (entity_id) WHERE source_id <> 'plan:p9#entity_exemplar' OR heir IS NOT NULL")
def entities_after_cleanup(spark, d):
    return _cleanup(spark, d)[0].select(F.col("id").cast("long").alias("id"), "source_id")


@query("WITH " + _ENT + ", g AS (SELECT heir FROM e LEFT JOIN h USING (entity_id) WHERE source_id = 'plan:p9#entity_exemplar') SELECT count(*) FILTER (WHERE heir IS NULL) AS entities_deleted, count(heir) AS entities_rewired, CAST(2 * count(*) FILTER (WHERE heir IS NULL) AS BIGINT) AS subject_rows_deleted, count(*) FILTER (WHERE heir IS NULL) AS derivation_rows_deleted FROM g")
def cleanup_counters(spark, d):
    return _cleanup(spark, d)[2]


@query(oracle("claims", "SELECT kind, count(*) AS n FROM claims WHERE kind IN ('click', 'purchase') GROUP BY 1 UNION ALL SELECT 'other: ' || string_agg(DISTINCT kind, ',' ORDER BY kind), 0 FROM claims WHERE kind NOT IN ('click', 'purchase') UNION ALL SELECT 'all', count(*) FROM claims"))
def gated_kinds(spark, d):
    """Claims of the plan's kinds, the kinds dropped, and a plan without kinds, which drops nothing."""
    c = B.claims(spark, d)
    kept, other = DOC.plan_gate(c, ["click", "purchase"])
    return kept.groupBy("kind").agg(F.count("*").alias("n")).union(c.agg(F.concat(F.lit("other: "), F.array_join(other, ",")).alias("kind"), F.lit(0).cast("long"))).union(DOC.plan_gate(c, [])[0].agg(F.lit("all"), F.count("*")))


_PATTERNS = """t AS (SELECT s_suppkey AS id, '{"a":["mine_' || (s_suppkey % 5) || '","mineX' || (s_suppkey % 3) || '"],"b":"x"y' || (s_suppkey % 2) || '"}' AS p FROM supplier),
n AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'mine_' || (c_custkey % 7) WHEN 1 THEN 'x_y' || (c_custkey % 4) ELSE '_in__' || (c_custkey % 5) END AS name FROM customer)"""


@query("WITH " + _PATTERNS + " SELECT name, count(*) AS n FROM n JOIN t ON p LIKE '%\"' || name || '\"%' GROUP BY 1")
def named_by_pattern(spark, d):
    """Names looked for between the quotes of JSON as LIKE does, where an underscore in a name fits any character, even a quote."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    texts = B.table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit('{"a":["mine_'), k % 5, F.lit('","mineX'), k % 3, F.lit('"],"b":"x"y'), k % 2, F.lit('"}')).alias("p"))
    names = B.table(spark, d, "customer").select(F.when(c % 3 == 0, F.concat(F.lit("mine_"), c % 7)).when(c % 3 == 1, F.concat(F.lit("x_y"), c % 4)).otherwise(F.concat(F.lit("_in__"), c % 5)).alias("name"))
    return T.quoted_names(texts, "id", "p", names, "name").groupBy("name").agg(F.count("*").alias("n"))


@query(oracle("outcomes recipes", "SELECT o.kind, count(*) AS n FROM outcomes o JOIN r ON r.recipe_id = o.recipe_id AND r.dedup_key LIKE o.plan_id || ':host1%' GROUP BY 1", "r AS (SELECT recipe_id, plan_id || ':' || source_id || ':metric:' || slot AS dedup_key FROM recipes)"))
def outcomes_of_prefixed_recipes(spark, d):
    """An equi-join with a test of the beginning of a key left over."""
    r = B.recipes(spark, d).select("recipe_id", F.concat_ws(":", "plan_id", "source_id", F.lit("metric"), "slot").alias("dedup_key"))
    o = B.outcomes(spark, d).select("recipe_id", "plan_id", "kind")
    return o.join(r, "recipe_id").filter(F.col("dedup_key").startswith(F.concat("plan_id", F.lit(":host1")))).groupBy("kind").agg(F.count("*").alias("n"))


@query(oracle("docs", "SELECT s.k, s.sample, d.id FROM (SELECT id % 50 AS k, min(source_id) AS sample FROM docs GROUP BY 1) s LEFT JOIN docs d ON d.source_id = s.sample AND length(d.body) > 2000"))
def documents_of_samples(spark, d):
    """A left join that gives a row for each document of a sample's source, and one for a sample without any."""
    docs = B.documents(spark, d).select("id", "source_id")
    s = docs.groupBy((F.col("id") % 50).alias("k")).agg(F.min("source_id").alias("sample"))
    right = B.documents(spark, d).filter("length(body) > 2000").select("id", F.col("source_id").alias("sample"))
    return s.join(right, "sample", "left").select("k", "sample", "id")


@query("WITH RECURSIVE p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 1 THEN s_suppkey - 1 END AS parent FROM supplier), l(root, depth, id, parent) AS (SELECT id, 0, id, parent FROM p UNION ALL SELECT l.root, l.depth + 1, p.id, p.parent FROM l JOIN p ON p.id = l.parent) SELECT root, depth, id FROM l")
def plan_lineage(spark, d):
    """Plans with the plans that they were made anew from; a cycle would be an error."""
    k = F.col("s_suppkey")
    return S.lineage(B.table(spark, d, "supplier").select(k.alias("plan"), F.when(k % 7 != 1, k - 1).alias("reclassified_from")), "plan", "reclassified_from")


@query(oracle("claims", "SELECT f.dedup_key, CASE WHEN c.id % 2 = 0 THEN 'relation' ELSE 'assertion' END AS record_type, CASE WHEN c.id % 2 = 1 THEN CASE WHEN auth THEN 'agency:authoritative' ELSE 'agency:consensus' END END AS claimant, c.kind || ',lithium,extra' AS topics, n_support, 'derived' AS license FROM facts f JOIN claims c ON c.id = f.rid", HASHES))
def promoted_rows(spark, d):
    """Whole rows of facts: relations to their table, attributes as assertions of the promoting agency, topics of the plan added."""
    c = B.claims(spark, d).select("id", F.when(F.col("id") % 2 == 0, "relation").otherwise("entity_attribute").alias("asserted_kind"), "observed_at", F.to_json(F.struct("kind", "rel_from")).alias("content"), F.array("kind", F.lit("lithium")).alias("topics"), F.array("rel_from", "rel_to").alias("entities"))
    return S.promoted_rows(_facts(spark, d), c, F.array(F.lit("lithium"), F.lit("extra"))).select("dedup_key", "record_type", "claimant", F.array_join("topics", ",").alias("topics"), "n_support", "license")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'a,a,b' ELSE 'a,a,b,c' END AS topics FROM nation")
def merged_topic_lists(spark, d):
    """Topics of a plan after a record's own, which keep their order and repeats."""
    plan = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("a")))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(S.merged_topics(F.array(F.lit("a"), F.lit("a"), F.lit("b")), plan), ",").alias("topics"))


@query("SELECT c_custkey AS plan_id, array_to_string(list_filter([CASE WHEN k = 0 THEN 'no topic tag' END, CASE WHEN k = 1 THEN 'bad topic tag' END, CASE WHEN k = 2 THEN 'window under one day' END, CASE WHEN k = 3 THEN 'window too long' END, CASE WHEN k IN (4, 5, 6) THEN 'bad attribute key' END, CASE WHEN k IN (0, 7) THEN 'no expectations' END, CASE WHEN k IN (2, 8) THEN 'blank interpretation' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT c_custkey, c_custkey % 10 AS k FROM customer)")
def plan_errors(spark, d):
    k = F.col("c_custkey") % 10
    plans = B.table(spark, d, "customer").select(
        F.col("c_custkey").alias("plan_id"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("ok"), F.lit("not ok"))).otherwise(F.array(F.lit("ok"))).alias("topic_tags"), F.when(k == 2, 0).when(k == 3, 3651).otherwise(3650).alias("window_days"),
        F.array(F.when(k == 4, "  ").when(k == 5, F.repeat(F.lit("k"), 65)).when(k == 6, "a b").otherwise(F.concat(F.lit(" "), F.repeat(F.lit("k"), 64)))).alias("attributes"), F.when(k.isin(0, 7), 0).otherwise(1).alias("n_expectations"), F.when(k.isin(2, 8), " \t").otherwise(" i ").alias("interpretation"),
    )
    plans = plans.withColumn("interpretation", F.regexp_replace("interpretation", "\t", " "))
    return S.plan_errors(plans).select("plan_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT c_custkey AS id, 'size' AS key, CASE c_custkey % 3 WHEN 0 THEN '12.5' WHEN 1 THEN 'true' ELSE 'large' END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'agency:document' ELSE 'agency:x' END AS claimant, 'asserted' AS stance FROM customer WHERE c_custkey % 5 <> 0")
def valid_attributes(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "number").when(k % 3 == 1, "boolean").otherwise("text")
    value = F.when(k % 15 == 0, "large").when(k % 3 == 0, " 12.5 ").when(k % 3 == 1, "true").otherwise("large")
    drafts = B.table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("mine:"), k).alias("entity_id"), F.when(k % 5 == 0, "colour").otherwise(" size ").alias("key"), kind.alias("value_kind"), value.alias("value"), F.when(k % 2 == 1, "agency:x").otherwise(" ").alias("claimant"), F.lit(None).cast("string").alias("stance"))
    return S.valid_attributes(drafts, ["size"]).select("id", "key", "value", "claimant", "stance")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 2")
def valid_entity_drafts(spark, d):
    k = F.col("c_custkey")
    drafts = B.table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "bad id").otherwise("mine:1").alias("entity_id"), F.when(k % 4 == 1, "  ").otherwise("Mine").alias("canonical_name"), F.when(k % 4 == 3, "ship").otherwise("mine").alias("kind"))
    return DOC.valid_entities(drafts, ["mine"]).select("id")


@query(oracle("claims", "SELECT id, array_to_string(list_sort(list_distinct([rel_from, rel_to])), ',') AS entities, 'extracted' AS license, (id % 9) || ':document:extraction' AS parent FROM claims"))
def extracted_records(spark, d):
    """Rows made of drafts, with their names as subjects and their document as parent."""
    drafts = B.claims(spark, d).select(F.col("id").alias("draft_id"), F.lit("relation").alias("record_type"), F.to_json(F.struct("kind")).alias("content"), F.array(F.concat(F.lit(" "), "rel_to"), F.col("rel_from"), F.lit("no id"), F.col("rel_to")).alias("names"), F.array(F.lit("lithium")).alias("topics"))
    return S.extracted_records(drafts, F.col("draft_id") % 9).select(F.col("draft_id").alias("id"), F.array_join("entities", ",").alias("entities"), "license", F.concat_ws(":", F.col("derived_from")[0]["parent_id"], F.col("derived_from")[0]["parent_type"], F.col("derived_from")[0]["role"]).alias("parent"))


_RUN = "o AS (SELECT user_id % 30 AS run_id, CASE event_id % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'declined' ELSE 'legacy_plan_cannot_author' END AS kind, CASE WHEN event_id % 6 = 0 THEN event_id % 50 END AS records FROM events)"


def _runs(spark, d):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in S.OUTCOMES]), (i % 6 + 1).cast("int"))
    return S.run_rollup(B.table(spark, d, "events").select((F.col("user_id") % 30).alias("run_id"), kind.alias("kind"), F.when(i % 6 == 2, F.element_at(F.array(*[F.lit(x) for x in S.STAGES]), (i % 4 + 1).cast("int"))).alias("stage"), F.when(i % 6 == 0, i % 50).alias("records")))


@query("WITH " + _RUN + " SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in S.OUTCOMES) + ", CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM o GROUP BY 1")
def run_rollups(spark, d):
    return _runs(spark, d)


@query("WITH " + _RUN + " SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in S.OUTCOMES) + ", CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM o")
def merged_reports(spark, d):
    return S.merged_reports(_runs(spark, d).drop("run_id"))


@query(oracle("claims", """SELECT id, substr(sha256('{"asserted_kind":"relation","from":"' || rel_from || '","kind":"a\\"b","to":"c\\\\d"}'), 1, 32) AS hash FROM claims""".replace("\\\\\\\\", "\\\\")))
def quoted_content_hashes(spark, d):
    """Quotes and backslashes in a value are escaped in the text that is hashed."""
    c = B.claims(spark, d).select("id", F.lit('a"b').alias("kind"), "rel_from", F.lit("c\\d").alias("rel_to"))
    return c.select("id", C.content_hash().alias("hash"))
