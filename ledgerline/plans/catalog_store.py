"""Further queries of the catalog: stored envelopes, typed reads, tags, tables and near misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.keys import recipe_dedup_key
from ..operators import audit
from ..sources import bridge as B
from ..sources import store
from ..sources.bridge import oracle
from . import catalog
from ..operators import dashboard as D
from .catalog import query


def _records(spark, d):
    c = B.claims(spark, d)
    edge = F.struct((F.col("id") - 1).cast("string").alias("parent_id"), F.lit("event").alias("parent_type"), F.lit("extraction").alias("role"))
    return c.select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "relation").otherwise("assertion").alias("record_type"), F.array("rel_from", "rel_to").alias("entities"), F.array(F.lit("CL")).alias("places"),
        F.array("kind", F.lit("lithium")).alias("topics"), F.when(F.col("id") % 2 == 0, F.array(edge)).otherwise(F.array().cast("array<struct<parent_id:string,parent_type:string,role:string>>")).alias("derived_from"), "observed_at", F.to_json(F.struct("kind", "rel_from")).alias("content"),
    )


@query(oracle("claims", "SELECT CAST(id AS VARCHAR) AS id, least(rel_from, rel_to) || ',' || greatest(rel_from, rel_to) AS entities, least(kind, 'lithium') || ',' || greatest(kind, 'lithium') AS topics FROM claims"))
def rebuilt_envelopes(spark, d):
    r = _records(spark, d)
    back = store.rebuilt(r.drop(*store.CHILDREN), store.exploded(r))
    return back.select("id", F.array_join("entities", ",").alias("entities"), F.array_join("topics", ",").alias("topics"))


@query(oracle("claims", "SELECT 'extraction' AS role, count(*) AS n FROM claims WHERE id % 2 = 0"))
def derivation_edges(spark, d):
    return store.exploded(_records(spark, d))["derived_from"].groupBy("role").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT CAST(id AS VARCHAR) AS id, kind, rel_from FROM claims WHERE id % 7 <> 0"))
def decoded_assertions(spark, d):
    r = _records(spark, d).select("id", F.when(F.col("id").cast("long") % 7 == 0, F.lit('{"kind":')).otherwise(F.col("content")).alias("content"))
    return store.decoded(r, "content", "kind string, rel_from string", ("kind", "rel_from"), strict=False)


@query(oracle("claims", "SELECT CASE WHEN id % 3 = 0 THEN 'event' ELSE 'relation' END AS record_type, count(*) AS n FROM claims GROUP BY 1"))
def types_of_ids(spark, d):
    ids = B.claims(spark, d).select("id")
    tables = {"event": ids.filter("id % 3 = 0"), "relation": ids}
    return store.types_of(ids, tables).groupBy("record_type").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT topic, CAST(count(DISTINCT id) AS BIGINT) AS n FROM (SELECT id, unnest([kind, 'lithium']) AS topic FROM claims) WHERE topic IN ('lithium', 'click') GROUP BY 1"))
def record_counts_of_topics(spark, d):
    topics = store.exploded(_records(spark, d))["topics"]
    return topics.filter(F.col("value").isin("lithium", "click")).groupBy(F.col("value").alias("topic")).agg(F.countDistinct("record_id").alias("n"))


@query(oracle("plans", "SELECT plan_id, 'a,' || topic AS tags FROM plans WHERE topic > 'a' "))
def parsed_topic_tags(spark, d):
    blob = F.concat(F.lit('["'), "topic", F.lit('", " "]\x1f[broken\x1f["a","'), "topic", F.lit('"]'))
    return B.plans(spark, d).select("plan_id", F.array_join(audit.parsed_tags(blob), ",").alias("tags"))


@query(oracle("recipes", "SELECT plan_id || ':' || source_id || ':metric:' || slot AS dedup_key, count(*) AS n FROM recipes GROUP BY 1"))
def recipe_keys(spark, d):
    return B.recipes(spark, d).groupBy(recipe_dedup_key(F.col("plan_id"), F.col("source_id"), F.lit("metric"), F.col("slot")).alias("dedup_key")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, n_name AS suggestion FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE length(n_name) > 2")
def near_misses(spark, d):
    """Names with two letters swapped, and the only name near them."""
    names = B.table(spark, d, "nation")
    wrong = F.concat(F.substring("n_name", 2, 1), F.substring("n_name", 1, 1), F.substring("n_name", 3, 100))
    typo = F.when(F.substring("n_name", 1, 1) == F.substring("n_name", 2, 1), F.concat("n_name", F.lit("x"))).otherwise(wrong)
    rows = B.table(spark, d, "customer").join(names.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").filter("length(n_name) > 2").select(F.col("c_custkey").alias("id"), typo.alias("typo"))
    return rows.join(T.near_misses(rows, "typo", names, "n_name"), "typo").select("id", "suggestion")


@query("SELECT c_custkey AS id, c_acctbal / 50 BETWEEN -180 AND 180 AND c_acctbal / 100 BETWEEN -90 AND 90 AS ok FROM customer")
def valid_positions(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), V.valid_position(F.col("c_acctbal") / 50, F.col("c_acctbal") / 100).alias("ok"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN format('{:,}', c_custkey) || ' t' WHEN 1 THEN 'true' ELSE '{\"kind\":\"topic_list\",\"value\":[\"a\",\"b\"]}' END AS shown FROM customer")
def attribute_tiles(spark, d):
    i = F.col("c_custkey")
    number = F.concat(F.lit('{"kind":"number","value":{"value":'), i, F.lit(',"unit":"t"}}'))
    value = F.when(i % 3 == 0, number).when(i % 3 == 1, F.lit('{"kind":"boolean","value":true}')).otherwise(F.lit('{"kind":"topic_list","value":["a","b"]}'))
    return B.table(spark, d, "customer").select(i.alias("id"), store.attribute_text(value).alias("shown"))


@query("SELECT 'h' || (event_id % 50) AS host, count(*) AS n FROM events WHERE event_id % 4 <> 3 AND event_id > 0 GROUP BY 1")
def probes_read(spark, d):
    i = F.col("event_id")
    line = F.when(i % 4 == 3, F.lit("short\tline")).otherwise(F.concat_ws("\t", F.concat(F.lit("H"), i % 50), F.lit("plain"), F.lit("200")))
    return store.probes_from_tsv(B.table(spark, d, "events").select(i.alias("line_no"), line.alias("value"))).groupBy("host").agg(F.count("*").alias("n"))


@query(oracle("outcomes", "SELECT regexp_extract(source_id, '^(nom:[0-9a-f-]+)', 1) AS nomination, max_by(kind, struct_pack(a := attempted_at, b := id)) AS status FROM outcomes GROUP BY 1"))
def nomination_status(spark, d):
    return B.outcomes(spark, d).groupBy(F.regexp_extract("source_id", "^(nom:[0-9a-f-]{36})", 1).alias("nomination")).agg(F.max_by("kind", F.struct("attempted_at", "id")).alias("status"))


RUNS = 40


@query(oracle("outcomes", "SELECT recipe_id, " + ", ".join(f"count(*) FILTER (WHERE place = {r}) AS run{r}" for r in range(1, RUNS + 1)) + " FROM outcomes JOIN r USING (run_id) GROUP BY 1", "r AS (SELECT run_id, row_number() OVER (ORDER BY max(attempted_at) DESC, run_id) AS place FROM outcomes GROUP BY 1)"))
def outcome_heatmap(spark, d):
    """Outcomes of each recipe in each of the latest runs, newest first: the columns are places, whatever the runs are called."""
    return D.heatmap(B.outcomes(spark, d), RUNS)


@query(oracle("docs", "SELECT id, length(body) > 0 AND norm = 'text/html' AS html, norm IN ('text/html', 'text/plain') AS eligible FROM (SELECT id, body, lower(trim(split_part(mime, ';', 1))) AS norm FROM docs)"))
def extraction_eligible(spark, d):
    m = T.mime(F.col("mime"))
    return B.documents(spark, d).select("id", ((F.length("body") > 0) & T.is_html(m)).alias("html"), (T.is_html(m) | m.startswith("text/plain")).alias("eligible"))
