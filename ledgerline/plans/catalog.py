"""Every query of the library over the fixed tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.keys import decline_shape, with_source_key
from ..functions.python_udfs import canonical_json, normalized_number
from ..operators import audit, claims as C, dashboard as D, documents as DOC, dml, entities as E, extraction as X
from ..operators import json_shapes as J
from ..operators import state as S
from ..sources import bridge as B
from ..sources.bridge import oracle
from ..streaming.backoff import host_backoff
from . import scoping

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
TOPICS = ("lithium",)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


UNIVERSE = "u AS (SELECT kind, rel_from, rel_to, count(DISTINCT claimant) AS n_claimants, count(*) AS n_claims FROM claims GROUP BY ALL)"

# --- claims: A9-A12, A14, A15, W1, PF13 ---------------------------------------------------


@query(oracle("claims", "SELECT * FROM u", UNIVERSE))
def triple_universe(spark, d):
    return C.triple_universe(B.claims(spark, d))


@query(oracle("claims", "SELECT n_claimants, count(*) AS n_triples, CAST(sum(n_claims) AS BIGINT) AS n_claims FROM u GROUP BY 1", UNIVERSE))
def triple_histogram(spark, d):
    return C.triple_histogram(B.claims(spark, d))


@query(oracle("claims", "SELECT * FROM u WHERE n_claimants = 1", UNIVERSE))
def triple_singletons(spark, d):
    return C.triple_universe(B.claims(spark, d)).filter("n_claimants = 1")


@query(oracle("claims", "SELECT kind, rel_from, rel_to, string_agg(DISTINCT claimant, ',' ORDER BY claimant) AS claimants, count(*) AS n_claims, count(DISTINCT claimant) AS n_claimants FROM claims GROUP BY 1, 2, 3 HAVING count(DISTINCT claimant) >= 3"))
def triple_quorum(spark, d):
    return C.quorum(B.claims(spark, d), 3).withColumn("claimants", F.array_join("claimants", ","))


@query(oracle("claims", "SELECT kind, CAST(sum(CASE WHEN n_claimants = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(sum(CASE WHEN n_claimants = 2 THEN 1 ELSE 0 END) AS BIGINT) AS pairs, CAST(sum(CASE WHEN n_claimants >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS quorums, count(*) AS triples FROM u GROUP BY kind", UNIVERSE))
def source_diversity(spark, d):
    return C.source_diversity(B.claims(spark, d))


@query(oracle("claims", "SELECT kind, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM (SELECT c.kind, u.n_claimants AS n FROM claims c JOIN u USING (kind, rel_from, rel_to)) GROUP BY kind", UNIVERSE))
def claimants_over_triple(spark, d):
    return C.claimants_over_triple(B.claims(spark, d)).groupBy("kind").agg(F.max("n_claimants").alias("most"), F.sum("n_claimants").alias("total"))


@query(oracle("claims", "SELECT kind, count(DISTINCT rel_from || '|' || rel_to) AS n_pairs, count(DISTINCT rel_from || rel_to) AS n_joined FROM claims GROUP BY kind"))
def distinct_concatenated(spark, d):
    return B.claims(spark, d).groupBy("kind").agg(F.countDistinct(F.concat("rel_from", F.lit("|"), "rel_to")).alias("n_pairs"), F.countDistinct(F.concat("rel_from", "rel_to")).alias("n_joined"))


@query(oracle("claims", "SELECT kind, count(*) AS n FROM claims WHERE observed_at >= TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 1 HOUR GROUP BY kind"))
def claims_of_last_hour(spark, d):
    return B.claims(spark, d).filter("observed_at >= timestamp_ntz'2024-01-01 12:00:00' - INTERVAL 1 HOUR").groupBy("kind").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT kind, count(*) AS n, count(DISTINCT claimant) AS claimants, CAST(CAST(min(observed_at) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(observed_at) AS DATE) AS VARCHAR) AS last_day FROM claims GROUP BY kind"))
def claim_summary(spark, d):
    day = lambda f: f("observed_at").cast("date").cast("string")
    return B.claims(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("claimant").alias("claimants"), day(F.min).alias("first_day"), day(F.max).alias("last_day"))


# --- promotion: P1-P11, J3, S8 ------------------------------------------------------------

# claimant, metric, topic, quorum
REGISTRY = [("Agency:2", None, "lithium", 1), ("agency:9", None, None, 1), ("3", None, "lithium", 2), ("agency:4", None, "cobalt", 1), ("5", "click", None, None), ("agency:5", "view", "lithium", 1), ("agency:6", "purchase", None, 2), ("source:1", None, None, 1)]
HASHES = """h AS (SELECT *, substr(sha256('{"asserted_kind":"relation","from":"' || rel_from || '","kind":"' || kind || '","to":"' || rel_to || '"}'), 1, 32) AS ch,
  substr(sha256('t:lithium' || chr(10) || 'e:' || least(rel_from, rel_to) || chr(10) || 'e:' || greatest(rel_from, rel_to) || chr(10)), 1, 32) AS sh FROM claims),
k AS (SELECT *, 'promotion:' || ch || ':' || sh AS dedup_key, claimant = 'agency:2' OR (claimant = 'agency:5' AND kind IN ('click', 'view')) AS auth,
  claimant = 'agency:3' OR (claimant = 'agency:6' AND kind = 'purchase') AS lowers, struct_pack(a := observed_at, b := id) AS o FROM h),
said AS (SELECT dedup_key, kind, rel_from, rel_to, true AS auth, CAST(1 AS BIGINT) AS n_claimants, CAST(1 AS BIGINT) AS n_support, max_by(source_id, o) AS representative, max_by(id, o) AS rid, max_by(confidence, o) AS mean FROM k WHERE auth GROUP BY ALL),
agreed AS (SELECT dedup_key, kind, rel_from, rel_to, false AS auth, count(DISTINCT claimant) AS n_claimants, count(*) AS n_support, max_by(source_id, o) AS representative, max_by(id, o) AS rid, avg(confidence) AS mean FROM k
  WHERE NOT auth GROUP BY dedup_key, kind, rel_from, rel_to HAVING count(DISTINCT claimant) >= CASE WHEN bool_or(lowers) THEN 2 ELSE 3 END),
facts AS (SELECT *, CAST(least(greatest(mean, 0), 1) AS DOUBLE) AS confidence FROM (SELECT * FROM said UNION ALL SELECT * FROM agreed WHERE dedup_key NOT IN (SELECT dedup_key FROM said))),
edges AS (SELECT dedup_key, rid AS id, 'promotion' AS role FROM facts WHERE auth UNION ALL SELECT k.dedup_key, k.id, 'consensus_support' FROM k JOIN facts f USING (dedup_key) WHERE NOT k.auth AND NOT f.auth)"""


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "claimant string, metric string, topic string, quorum int")


def _facts(spark, d, promoted=None):
    return C.promote(B.claims(spark, d), _registry(spark), promoted if promoted is not None else spark.createDataFrame([], "dedup_key string"), TOPICS)


def _edges(spark, d):
    judged = C.judged(B.claims(spark, d), _registry(spark), TOPICS)
    return C.support_edges(C.promoted_groups(judged), judged)


@query(oracle("claims", "SELECT dedup_key, kind, rel_from, rel_to, n_claimants, n_support, representative, round(confidence + 0.0000003, 4) AS confidence, CASE WHEN auth THEN 'derived#authoritative' ELSE 'derived#consensus' END AS source_id FROM facts", HASHES))
def promoted_facts(spark, d):
    """Facts with their support; the small addend keeps 32-bit confidences from either side of a tie in rounding."""
    return _facts(spark, d).drop("representative_id").withColumn("confidence", F.round(F.col("confidence").cast("double") + F.lit(3e-7), 4))


@query(oracle("claims", "SELECT count(*) AS n FROM facts WHERE false", HASHES))
def promoted_again(spark, d):
    """A second promotion over the facts of the first makes none."""
    return _facts(spark, d, _facts(spark, d).select("dedup_key")).agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT count(*) AS promoted, count(*) FILTER (WHERE auth) AS authoritative, count(*) FILTER (WHERE NOT auth) AS consensus, CAST(coalesce(sum(n_support), 0) AS BIGINT) AS supporting, (SELECT count(*) FROM claims) AS considered FROM facts", HASHES))
def promotion_report(spark, d):
    return C.promotion_report(_facts(spark, d), B.claims(spark, d))


@query(oracle("claims", "SELECT role, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM edges GROUP BY 1", HASHES))
def support_edges(spark, d):
    return _edges(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.sum("parent_id").alias("ids"))


@query(oracle("claims", "SELECT kind, count(*) AS n FROM k WHERE id NOT IN (SELECT id FROM edges) GROUP BY kind", HASHES))
def unpromoted_claims(spark, d):
    return C.unpromoted(B.claims(spark, d), _edges(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT id, auth AS alone, CASE WHEN claimant = 'agency:2' OR (claimant = 'agency:5' AND kind = 'view') THEN 1 WHEN lowers THEN 2 END AS lowered FROM k", HASHES))
def registry_verdicts(spark, d):
    """What a registry with gates for metric and topic says of each claim."""
    return C.judged(B.claims(spark, d), _registry(spark), TOPICS).select("id", "alone", "lowered")


# --- P1 for every kind ----------------------------------------------------------------------


@query("""SELECT event_id AS id, substr(sha256(CASE event_id % 4
  WHEN 0 THEN '{"asserted_kind":"observation","currency":null,"metric":"m' || (user_id % 7) || '","period":"annual","unit":"t","value":' || CAST(user_id AS BIGINT) || '.5,"value_uncertainty":null}'
  WHEN 1 THEN '{"actors":["company:' || user_id || '"],"asserted_kind":"event","direction":null,"event_type":"' || event_type || '","headline":"h"}'
  WHEN 2 THEN '{"asserted_kind":"relation","from":"company:' || user_id || '","kind":"owns","to":"mine:1"}'
  ELSE '{"asserted_kind":"entity_attribute","entity_id":"mine:' || user_id || '","key":"size","value":{"kind":"number","value":' || user_id || '.0}}' END), 1, 32) AS hash FROM events""")
def content_hashes(spark, d):
    """Hashes of what each kind of claim asserts, whatever the order of its fields; fields that are always written are null where they are not given."""
    u = F.col("user_id").cast("string")
    which = F.col("event_id") % 4
    content = (
        F.when(which == 0, F.concat(F.lit('{ "value": '), u, F.lit('.50, "unit": "t", "period":"annual", "metric":"m'), F.col("user_id") % 7, F.lit('"}')))
        .when(which == 1, F.concat(F.lit('{"headline":"h","event_type":"'), "event_type", F.lit('","actors":["company:'), u, F.lit('"]}')))
        .when(which == 2, F.concat(F.lit('{"to":"mine:1","kind":"owns","from":"company:'), u, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"value":{"value":'), u, F.lit('.0,"kind":"number"},"key":"size","entity_id":"mine:'), u, F.lit('"}')))
    )
    kind = F.when(which == 0, "observation").when(which == 1, "event").when(which == 2, "relation").otherwise("entity_attribute")
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), C.asserted_hash(kind, content).alias("hash"))


# --- keys and plan scoping: P22, PF1, J4, J7-J9, J11, S2, PF18 ------------------------------


@query(oracle("claims", r"SELECT id, regexp_extract(source_id, '^(.*)#recipe:', 1) AS src_base, regexp_extract(source_id, '#recipe:([0-9a-f-]+)@', 1) AS recipe_id, CAST(regexp_extract(source_id, '@v([0-9]+)$', 1) AS INT) AS recipe_version, 'recipe' AS origin FROM claims"))
def parsed_source_ids(spark, d):
    return with_source_key(B.claims(spark, d)).select("id", "src_base", "recipe_id", "recipe_version", "origin")


@query(oracle("claims plans recipes", "SELECT p.plan_id, p.topic, p.status, count(DISTINCT c.id) AS n FROM plans p LEFT JOIN recipes r ON r.plan_id = p.plan_id LEFT JOIN claims c ON c.source_id LIKE '%#recipe:' || r.recipe_id || '@v%' GROUP BY 1, 2, 3"))
def claims_of_plans(spark, d):
    return scoping.counts_by_plan(B.claims(spark, d), B.recipes(spark, d), B.plans(spark, d))


@query(oracle("claims plans recipes", "SELECT p.topic, c.id, c.kind FROM plans p JOIN recipes r ON r.plan_id = p.plan_id JOIN claims c ON c.source_id LIKE '%#recipe:' || r.recipe_id || '@%' WHERE p.status = 'accepted'"))
def records_of_accepted_plans(spark, d):
    found = scoping.records_of_plans(B.claims(spark, d), B.recipes(spark, d))
    return found.join(scoping.with_status(B.plans(spark, d), "accepted"), "plan_id").select("topic", "id", "kind")


@query(oracle("plans recipes", "SELECT p.plan_id, p.topic, count(r.recipe_id) AS n_recipes, CAST(coalesce(max(r.version), 0) AS BIGINT) AS newest FROM plans p LEFT JOIN recipes r ON r.plan_id = p.plan_id GROUP BY 1, 2"))
def recipes_per_plan(spark, d):
    per = B.plans(spark, d).join(B.recipes(spark, d), "plan_id", "left").groupBy("plan_id", "topic")
    return per.agg(F.count("recipe_id").alias("n_recipes"), F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("newest"))


@query(oracle("claims outcomes attempts", "SELECT 'claims' AS name, count(*) AS n FROM claims UNION ALL SELECT 'outcomes', count(*) FROM outcomes UNION ALL SELECT 'attempts', count(*) FROM attempts"))
def table_counts(spark, d):
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n("claims", B.claims(spark, d)).union(n("outcomes", B.outcomes(spark, d))).union(n("attempts", B.attempts(spark, d)))


@query(oracle("claims docs", "SELECT t, split_part(source_id, '#', 1) AS base, count(*) AS n FROM (SELECT 'claims' AS t, source_id FROM claims UNION ALL SELECT 'documents', source_id FROM docs) GROUP BY 1, 2"))
def sources_by_table(spark, d):
    named = lambda t, df: df.select(F.lit(t).alias("t"), "source_id")
    return named("claims", B.claims(spark, d)).unionByName(named("documents", B.documents(spark, d))).groupBy("t", F.split_part("source_id", F.lit("#"), F.lit(1)).alias("base")).agg(F.count("*").alias("n"))


@query(oracle("claims docs", "c AS (SELECT 1)").replace("c AS (SELECT 1)", "SELECT a.source_id, a.n, count(d.id) AS n_documents FROM (SELECT source_id, count(*) AS n FROM claims GROUP BY 1) a LEFT JOIN docs d ON split_part(d.source_id, '@', 1) = split_part(a.source_id, '@', 1) GROUP BY 1, 2"))
def claims_and_documents_of_sources(spark, d):
    base = lambda c: F.split_part(c, F.lit("@"), F.lit(1))
    n = B.claims(spark, d).groupBy("source_id").agg(F.count("*").alias("n")).withColumn("base", base("source_id"))
    docs = B.documents(spark, d).groupBy(base("source_id").alias("base")).agg(F.count("*").alias("k"))
    return n.join(docs, "base", "left").select("source_id", "n", F.coalesce("k", F.lit(0)).cast("long").alias("n_documents"))


# --- audit: A1, A4, A13, A16, A18, A19, A21, A22, J1, J2, W2-W6, W10, L1-L8, P23 ------------


@query(oracle("outcomes plans", "SELECT p.plan_id, p.topic, count(*) FILTER (WHERE kind = 'succeeded') AS succeeded, count(*) FILTER (WHERE kind = 'declined') AS declined, count(*) FILTER (WHERE kind = 'failed') AS failed, count(o.id) AS total, count(DISTINCT run_id) AS runs FROM plans p LEFT JOIN outcomes o USING (plan_id) GROUP BY 1, 2"))
def outcome_pivot(spark, d):
    return audit.outcome_pivot(B.outcomes(spark, d), B.plans(spark, d))


@query(oracle("attempts recipes plans", "SELECT source_id, count(*) FILTER (WHERE succeeded) AS n_success, CAST(max(attempted_at) FILTER (WHERE succeeded) AS VARCHAR) AS last_success, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM attempts JOIN recipes USING (recipe_id) JOIN plans USING (plan_id) GROUP BY 1 HAVING count(*) FILTER (WHERE succeeded) > 0 ORDER BY 2 DESC, max(attempted_at) FILTER (WHERE succeeded) DESC, 1 LIMIT 30"))
def sources_memory(spark, d):
    m = audit.sources_memory(B.recipes(spark, d), B.attempts(spark, d), B.plans(spark, d))
    return m.select("source_id", "n_success", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), F.array_join("topics", ",").alias("topics"))


@query(oracle("outcomes", "SELECT kind, count(*) AS n FROM outcomes GROUP BY kind"))
def outcome_kinds(spark, d):
    return B.outcomes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT kind AS topic, count(*) AS n FROM claims GROUP BY 1 ORDER BY n DESC, topic LIMIT 30"))
def topics_in_use(spark, d):
    return B.claims(spark, d).groupBy(F.col("kind").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(30)


@query(oracle("outcomes", "SELECT CASE WHEN source_id LIKE 'nom:%:%:%' THEN 'per_expectation' WHEN source_id LIKE 'nom:%' THEN 'nomination_level' ELSE 'other' END AS shape, CASE WHEN source_id LIKE 'nom:%:%:%' THEN split_part(source_id, ':', 3) END AS bucket, count(*) AS n FROM outcomes WHERE kind = 'declined' GROUP BY 1, 2"))
def decline_shapes(spark, d):
    s = F.col("source_id")
    shape = decline_shape(s)
    return B.outcomes(spark, d).filter("kind = 'declined'").groupBy(shape.alias("shape"), F.when(shape == "per_expectation", F.split_part(s, F.lit(":"), F.lit(3))).alias("bucket")).agg(F.count("*").alias("n"))


@query(oracle("outcomes", "SELECT substr(source_id, 1, 40) AS nomination, count(*) AS declines FROM outcomes WHERE kind = 'declined' GROUP BY 1"))
def decline_counts(spark, d):
    return audit.decline_counts(B.outcomes(spark, d))


@query(oracle("outcomes", "SELECT substr(message, 1, 3) AS head, count(*) AS n FROM outcomes WHERE kind <> 'succeeded' GROUP BY 1 ORDER BY n DESC, head LIMIT 4"))
def message_heads(spark, d):
    return B.outcomes(spark, d).filter("kind <> 'succeeded'").groupBy(F.substring("message", 1, 3).alias("head")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head").limit(4)


@query(oracle("outcomes", "SELECT kind, CAST(round_even(avg(n), 0) AS INT) AS mean FROM (SELECT kind, run_id, count(*) AS n FROM outcomes GROUP BY 1, 2) GROUP BY 1"))
def mean_outcomes_per_run(spark, d):
    per = B.outcomes(spark, d).groupBy("kind", "run_id").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.bround(F.avg("n")).cast("int").alias("mean"))


@query(oracle("outcomes", "SELECT kind, round(avg(n), 6) AS mean, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(coalesce(stddev_pop(n), 0), 6) AS sd FROM (SELECT kind, run_id, count(*) AS n FROM outcomes GROUP BY 1, 2) GROUP BY 1"))
def trial_statistics(spark, d):
    per = B.outcomes(spark, d).groupBy("kind", "run_id").agg(F.count("*").alias("n"))
    return per.groupBy("kind").agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.coalesce(F.stddev_pop("n"), F.lit(0.0)), 6).alias("sd"))


@query(oracle("recipes", "SELECT plan_id, slot, max_by(recipe_id, struct_pack(v := version, r := recipe_id)) AS recipe_id FROM recipes GROUP BY 1, 2"))
def latest_recipes(spark, d):
    return audit.latest_by(B.recipes(spark, d), ["plan_id", "slot"], F.desc("version"), F.desc("recipe_id")).select("plan_id", "slot", "recipe_id")


@query(oracle("outcomes", "SELECT source_id, id, CAST(attempted_at AS VARCHAR) AS attempted_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY attempted_at DESC, id DESC) AS r FROM outcomes WHERE kind = 'failed') WHERE r = 1"))
def latest_failures(spark, d):
    found = audit.latest_by(B.outcomes(spark, d).filter("kind = 'failed'"), ["source_id"], F.desc("attempted_at"), F.desc("id"))
    return found.select("source_id", "id", F.date_format("attempted_at", "yyyy-MM-dd HH:mm:ss").alias("attempted_at"))


@query(oracle("outcomes", "SELECT o.plan_id, o.recipe_id, string_agg(kind, ',' ORDER BY attempted_at, id) AS history, count(*) AS n FROM outcomes o JOIN r ON r.plan_id = o.plan_id AND r.run_id = o.run_id AND r.k <= 3 GROUP BY 1, 2", "r AS (SELECT plan_id, run_id, row_number() OVER (PARTITION BY plan_id ORDER BY max(attempted_at) DESC, run_id) AS k FROM outcomes GROUP BY 1, 2)"))
def run_history(spark, d):
    return audit.run_history(B.outcomes(spark, d), 3)


@query(oracle("outcomes", "SELECT id, kind FROM (SELECT *, rank() OVER (ORDER BY attempted_at DESC) AS r FROM outcomes) WHERE r <= 50"))
def trimmed_log(spark, d):
    return audit.trimmed(B.outcomes(spark, d), "attempted_at", 50).select("id", "kind")


@query(oracle("outcomes", "SELECT plan_id, id FROM (SELECT *, rank() OVER (PARTITION BY plan_id ORDER BY attempted_at DESC) AS r FROM outcomes) WHERE r <= 20"))
def trimmed_log_per_plan(spark, d):
    return audit.trimmed(B.outcomes(spark, d), "attempted_at", 20, ("plan_id",)).select("plan_id", "id")


@query(oracle("claims", "SELECT id, claimant FROM claims ORDER BY observed_at DESC, id DESC LIMIT 30"))
def recent_claims(spark, d):
    return B.claims(spark, d).orderBy(F.desc("observed_at"), F.desc("id")).limit(30).select("id", "claimant")


@query(oracle("claims", "SELECT kind, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY observed_at DESC, id DESC) AS r FROM claims) WHERE r <= 5"))
def recent_claims_per_kind(spark, d):
    w = audit.Window.partitionBy("kind").orderBy(F.desc("observed_at"), F.desc("id"))
    return B.claims(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("kind", "id")


@query(oracle("outcomes", "SELECT id FROM outcomes ORDER BY attempted_at DESC, id LIMIT 1 OFFSET 19"))
def twentieth_outcome(spark, d):
    return B.outcomes(spark, d).orderBy(F.desc("attempted_at"), "id").offset(19).limit(1).select("id")


@query("SELECT event_id AS id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_minute(spark, d):
    return audit.rolling_sum(B.table(spark, d, "events"), "user_id", "ts", "value", 60).select(F.col("event_id").alias("id"), F.round("rolling", 6).alias("rolling"))


CALLS = "calls AS (SELECT 'p' || (user_id % 2) AS provider, CASE event_id % 3 WHEN 0 THEN 'frontier' WHEN 1 THEN 'workhorse' ELSE 'cheap' END AS tier, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS purpose, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 1000 END AS input_tokens, event_id % 100 AS output_tokens, CASE WHEN event_id % 2 = 0 THEN event_id % 500 END AS cached_tokens FROM events)"


@query("WITH " + CALLS + " SELECT provider, tier, purpose, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, count(cached_tokens) AS cached_calls, round(CASE WHEN sum(input_tokens) > 0 THEN greatest(least(sum(cached_tokens) / sum(input_tokens), 1), 0) END, 6) AS cache_ratio FROM calls GROUP BY 1, 2, 3")
def cost_ledger(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    calls = B.table(spark, d, "events").select(
        F.concat(F.lit("p"), u % 2).alias("provider"), F.when(i % 3 == 0, "frontier").when(i % 3 == 1, "workhorse").otherwise("cheap").alias("tier"), F.when(i % 5 != 0, F.col("event_type")).alias("purpose"),
        F.when(i % 7 != 0, i % 1000).alias("input_tokens"), (i % 100).alias("output_tokens"), F.when(i % 2 == 0, i % 500).alias("cached_tokens"),
    )
    return audit.cost_ledger(calls).withColumn("cache_ratio", F.round("cache_ratio", 6))


@query("SELECT host, CASE WHEN plain BETWEEN 200 AND 399 THEN 'open' WHEN browser BETWEEN 200 AND 399 THEN 'browser_only' WHEN bot BETWEEN 200 AND 399 OR none BETWEEN 200 AND 399 THEN 'bot_only' ELSE 'blocked' END AS host_class FROM (SELECT 'h' || (user_id % 200) AS host, max_by(s, event_id) FILTER (WHERE a = 0) AS plain, max_by(s, event_id) FILTER (WHERE a = 1) AS browser, max_by(s, event_id) FILTER (WHERE a = 2) AS bot, max_by(s, event_id) FILTER (WHERE a = 3) AS none FROM (SELECT *, event_id % 4 AS a, 200 + (event_id % 3) * 100 + CASE WHEN event_id % 3 = 2 THEN 3 ELSE 0 END AS s FROM events) GROUP BY 1)")
def host_classes(spark, d):
    i = F.col("event_id")
    agent = F.element_at(F.array(*[F.lit(x) for x in ("plain", "browser", "bot", "none")]), (i % 4 + 1).cast("int"))
    probes = B.table(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 200).alias("host"), agent.alias("agent"), (F.lit(200) + i % 3 * 100 + F.when(i % 3 == 2, 3).otherwise(0)).alias("status"), i.alias("seq"))
    return audit.host_classes(probes)


# --- DML: A3, S3-S11, SC11, SC12, PF4-PF6, PF14 --------------------------------------------


@query(oracle("recipes", "SELECT plan_id, slot, version FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, slot ORDER BY n DESC, recipe_id DESC) AS r FROM (SELECT plan_id, slot, version, recipe_id, 0 AS n FROM recipes WHERE version < 3 UNION ALL SELECT plan_id, slot, version, recipe_id, 1 FROM recipes WHERE version = 3)) WHERE r = 1"))
def upserted_feedback(spark, d):
    r = B.recipes(spark, d)
    return audit.upserted(r.filter("version < 3"), r.filter("version = 3"), ["plan_id", "slot"], "recipe_id").select("plan_id", "slot", "version")


@query(oracle("claims plans recipes", "SELECT id FROM claims WHERE regexp_extract(source_id, '#recipe:([0-9a-f-]+)@', 1) NOT IN (SELECT recipe_id FROM recipes JOIN plans USING (plan_id) WHERE status = 'rejected')"))
def without_rejected_plans(spark, d):
    gone = B.recipes(spark, d).join(scoping.with_status(B.plans(spark, d), "rejected"), "plan_id").select("recipe_id")
    return dml.deleted(with_source_key(B.claims(spark, d)), gone, ["recipe_id"]).select("id")


@query(oracle("claims recipes", "SELECT c.id, CASE WHEN r.recipe_id IS NOT NULL THEN 'recipe' ELSE 'unknown' END AS parent_type FROM claims c LEFT JOIN recipes r ON r.recipe_id = regexp_extract(c.source_id, '#recipe:([0-9a-f-]+)@', 1)"))
def backfilled_parent_types(spark, d):
    return dml.backfilled(with_source_key(B.claims(spark, d)), "recipe_id", {"recipe": B.recipes(spark, d).select("recipe_id")}).select("id", "parent_type")


@query(oracle("entities", "SELECT e.entity_id, CASE WHEN p.k % 3 = 2 THEN n.k ELSE p.k END AS plan, p.k % 3 = 2 AS rewired FROM (SELECT DISTINCT entity_id, seq, nation % 5 AS k FROM entities) p JOIN (SELECT seq, entity_id FROM entities) e USING (seq) LEFT JOIN (SELECT nation % 300 AS i, min(nation % 5) AS k FROM entities WHERE nation % 5 % 3 = 0 GROUP BY 1) n ON e.entity_id = 'company:' || n.i WHERE p.k % 3 <> 2 OR n.k IS NOT NULL"))
def rewired_entities(spark, d):
    e = B.entities(spark, d)
    k = F.col("nation") % 5
    named = e.groupBy(k.alias("seq")).agg(F.collect_set(F.concat(F.lit("company:"), F.col("nation") % 300)).alias("ids"))
    plans = named.select(F.col("seq").alias("plan_id"), "seq", F.when(F.col("seq") % 3 == 0, "accepted").when(F.col("seq") % 3 == 2, "rejected").otherwise("pending").alias("status"), "ids")
    return E.rewired(e.select("entity_id", k.alias("plan_id")), plans).select("entity_id", F.col("plan_id").alias("plan"), "rewired")


@query(oracle("claims", "SELECT id, json_extract_string(j, '$.kind') AS kind FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '{\"kind\":\"' || kind || '\"}' ELSE '{\"asserted_kind\":\"relation\",\"kind\":\"' || kind || '\"}' END AS j FROM claims) WHERE NOT (json_extract_string(j, '$.asserted_kind') IS NULL AND json_extract_string(j, '$.kind') IS NOT NULL)"))
def purged_poison_rows(spark, d):
    j = F.when(F.col("id") % 5 == 0, F.to_json(F.struct("kind"))).otherwise(F.to_json(F.struct(F.lit("relation").alias("asserted_kind"), "kind")))
    return dml.without_poison(B.claims(spark, d).select("id", j.alias("content"))).select("id", F.get_json_object("content", "$.kind").alias("kind"))


# --- entities: P13-P18 --------------------------------------------------------------------


@query(oracle("entities", "SELECT entity_id, min(seq) AS seq, min_by(score, seq) AS score, min_by(nation, seq) AS nation, max_by(kind, o) AS kind, max_by(canonical_name, o) AS canonical_name, max_by(license, o) AS license, CAST(max(t) AS BIGINT) AS tier, count(*) AS n_rows FROM (SELECT *, struct_pack(t := t, s := -seq) AS o FROM (SELECT *, CASE license WHEN 'extracted' THEN 3 WHEN 'classifier-emitted' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS t FROM entities)) GROUP BY 1"))
def tiered_entities(spark, d):
    return E.tiered_upsert(B.entities(spark, d))


@query(oracle("entities", "SELECT entity_id, seq, CAST(old_tier AS INT) AS old_tier, CAST(t AS INT) AS new_tier FROM (SELECT *, max(t) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_tier FROM (SELECT *, CASE license WHEN 'extracted' THEN 3 WHEN 'classifier-emitted' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS t FROM (SELECT 'c:' || (seq % 101) AS entity_id, seq, license FROM entities))) WHERE old_tier IS NOT NULL AND t > old_tier"))
def entity_refreshes(spark, d):
    return E.refresh_log(B.entities(spark, d).withColumn("entity_id", F.concat(F.lit("c:"), F.col("seq") % 101))).select("entity_id", "seq", "old_tier", "new_tier")


@query(oracle("plans", "SELECT 'mine:' || topic || '_' || i AS entity_id, 'mine' AS kind, topic || ' ' || i AS canonical_name, 'classifier-emitted' AS license, 'plan:' || plan_id || '#entity_exemplar' AS source_id FROM plans, (SELECT unnest([1, 2]) AS i)"))
def entity_exemplars(spark, d):
    ids = F.array(*[F.concat(F.lit("mine:"), F.replace("topic", F.lit(" "), F.lit(" ")), F.lit(f"_{i}")) for i in (1, 2)])
    kinds = F.array(F.struct(F.lit(" mine ").alias("kind"), ids.alias("ids")), F.struct(F.lit(" ").alias("kind"), ids.alias("ids")))
    return E.entity_exemplars(B.plans(spark, d).withColumn("entity_kinds", kinds))


@query(oracle("plans", "SELECT 'plan:' || plan_id || '#relation_exemplar:operates:company:' || seq || ':mine:' || i AS dedup_key, 'operates' AS kind, 'company:' || seq AS rel_from, 'mine:' || i AS rel_to FROM plans, (SELECT unnest([1, 2]) AS i) WHERE NOT (seq = 0 AND i = 1)"))
def relation_exemplars(spark, d):
    pair = lambda i: F.struct(F.concat(F.lit("company:"), "seq").alias("from"), F.lit(f"mine:{i}").alias("to"))
    plans = B.plans(spark, d).withColumn("relation_kinds", F.array(F.struct(F.lit("operates").alias("kind"), F.array(pair(1), pair(2), pair(1)).alias("pairs"))))
    known = B.plans(spark, d).filter("seq = 0").select(F.concat(F.lit("plan:"), "plan_id", F.lit("#relation_exemplar:operates:company:0:mine:1")).alias("dedup_key"))
    return E.relation_exemplars(plans, known)


# --- documents and text: N1-N5, N9-N12, N22, PF12, PF16, A17, J13, J14, P19, W2 -------------

MIME = "m AS (SELECT *, lower(trim(split_part(mime, ';', 1))) AS norm FROM docs)"


@query(oracle("docs", "SELECT norm AS mime, CASE WHEN norm = 'text/html' THEN 'article' WHEN norm = 'application/pdf' THEN 'filing' WHEN norm = 'text/plain' THEN 'transcript' ELSE 'data_feed' END AS kind, norm = 'application/pdf' AS is_binary, CASE WHEN length(body) = 0 THEN '0' WHEN length(body) < 256 THEN '1-255' WHEN length(body) < 4096 THEN '256-4k' WHEN length(body) < 32768 THEN '4k-32k' ELSE '32k+' END AS size, count(*) AS n FROM m GROUP BY 1, 2, 3, 4", MIME))
def document_kinds(spark, d):
    m = T.mime(F.col("mime"))
    return B.documents(spark, d).groupBy(m.alias("mime"), T.document_kind(m).alias("kind"), T.is_binary(m).alias("is_binary"), T.length_bucket(F.length("body")).alias("size")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&quot;', '\"'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages".replace('\\"', '"'))
def stripped_pages(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.stripped_html(F.col("html")).alias("body"))


@query(None)
def index_pages(spark, d):
    return DOC.with_index_signal(B.table(spark, d, "pages").withColumn("mime", F.lit("text/html")), "html", "mime", "url").select("page_id", "anchor", "other", "signal")


@query(None)
def culled_claims(spark, d):
    pages = DOC.with_index_signal(B.table(spark, d, "pages").withColumn("mime", F.lit("text/html")), "html", "mime", "url")
    documents = pages.select((F.concat(F.lit("host"), F.col("page_id") % 15)).alias("source_id"), F.col("page_id").alias("id"), F.col("page_id").alias("observed_at"), "signal")
    claims = with_source_key(B.claims(spark, d)).select("id", F.col("src_base").alias("source_id"))
    return DOC.cull(claims, documents).groupBy("action").agg(F.count("*").alias("n"))


@query(oracle("docs recipes", "SELECT r.recipe_id IS NOT NULL AS routed, count(*) AS n FROM docs d LEFT JOIN recipes r ON r.recipe_id = regexp_extract(d.source_id, '#recipe:([0-9a-f-]+)@', 1) AND r.version > 1 GROUP BY 1"))
def reextraction_routes(spark, d):
    return DOC.reextraction_routes(B.documents(spark, d), B.recipes(spark, d).filter("version > 1")).groupBy("routed").agg(F.count("*").alias("n"))


@query(oracle("docs", "SELECT lang, CAST(sum((length(lower(body)) - length(replace(lower(body), 'tion', ''))) / 4) AS BIGINT) AS n FROM docs GROUP BY lang"))
def word_occurrences(spark, d):
    return B.documents(spark, d).groupBy("lang").agg(F.sum(T.occurrences(F.lower("body"), F.lit("tion"))).alias("n"))


@query(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND regexp_matches(w, '[a-z]') AND w NOT IN ('this','that','these','those','with','from','into','have','been','will','their','they','them','what','when','where','while','which','such','also','more','than','only','over','about','annual','data','report','page','table','year','https','http')))), ' ') AS words FROM benchmark")
def relevance_words(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", F.array_join(T.relevance_words(F.col("text")), " ").alias("words"))


@query(oracle("docs", "SELECT id, CAST((length(lower(body)) - length(replace(lower(body), 'tion', ''))) / 4 + (length(lower(body)) - length(replace(lower(body), 'heit', ''))) / 4 AS BIGINT) AS score FROM docs"))
def relevance_scores(spark, d):
    return B.documents(spark, d).select("id", T.relevance_score(F.col("body"), F.array(F.lit("tion"), F.lit("heit"))).alias("score"))


PAGES = "p AS (SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS page_no, l_partkey % 5 AS score, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"


@query("WITH " + PAGES + ", q AS (SELECT *, max(score) OVER (PARTITION BY doc) AS best, sum(size) OVER (PARTITION BY doc ORDER BY CASE WHEN page_no < 3 THEN 0 ELSE 1 END, CASE WHEN page_no < 3 THEN 0 ELSE -score END, page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM p) SELECT doc, page_no FROM q WHERE best <= 0 OR page_no < 3 OR s <= 120")
def selected_pages(spark, d):
    w = audit.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("page_no"), (F.col("l_partkey") % 5).alias("score"), F.col("l_quantity").cast("long").alias("size"))
    return DOC.selected_pages(p, 120).select("doc", "page_no")


@query("SELECT 'k' AS path, 'number' AS value_kind, count(*) AS n, min(json_extract_string(props, '$.k')) AS sample, CAST(NULL AS INT) AS longest FROM events")
def json_shape(spark, d):
    """Paths one level deep with their kinds, counts, least samples and longest arrays."""
    paths = J.json_paths(B.table(spark, d, "events"), ["event_id"], "props").filter("size(place) = 1")
    return paths.groupBy(F.substring("path", 3, 1000).alias("path"), F.col("kind").alias("value_kind")).agg(F.count("*").alias("n"), F.min("sample").alias("sample"), F.max("length").cast("int").alias("longest"))


@query(r"SELECT event_id, regexp_replace(regexp_replace('call with Bearer abc' || event_id || ' and ' || repeat('ab12', 12) || ' end', '([Bb]earer )\S+', '\1***', 'g'), '[A-Za-z0-9+/_-]{40,}', '***', 'g') AS line FROM events WHERE event_type = 'error'")
def scrubbed_logs(spark, d):
    line = F.concat(F.lit("call with Bearer abc"), "event_id", F.lit(" and "), F.repeat(F.lit("ab12"), 12), F.lit(" end"))
    return B.table(spark, d, "events").filter("event_type = 'error'").select("event_id", T.scrubbed(line).alias("line"))


@query("SELECT event_id, CASE WHEN c = 401 THEN 'host_requires_auth' WHEN c = 403 THEN 'host_blocked_by_waf' WHEN c BETWEEN 400 AND 499 THEN 'url_shape_mismatch' ELSE 'host_unreachable' END AS class FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 ELSE 302 END AS c FROM events)")
def status_classes(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in (401, 403, 404, 429, 503, 302)]), (F.col("event_id") % 6 + 1).cast("int"))
    return B.table(spark, d, "events").select("event_id", T.status_class(code).alias("class"))


@query("SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS n FROM events")
def normalized_numbers(spark, d):
    """Values written with a currency, commas and a unit, read back."""
    text = F.concat(F.lit("~ $"), F.format_number(F.round(F.col("value") * 1000), 0), F.lit(" t"))
    return B.table(spark, d, "events").select("event_id", normalized_number(text).cast("long").alias("n"))


@query("SELECT event_id, sha256('{\"b\":' || json_extract_string(props, '$.k') || ',\"e\":\"' || event_type || '\"}') AS hash FROM events")
def canonical_hashes(spark, d):
    j = F.concat(F.lit('{"e": "'), "event_type", F.lit('", "b": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return B.table(spark, d, "events").select("event_id", F.sha2(canonical_json(j), 256).alias("hash"))


@query("SELECT c_custkey AS id, c_mktsegment = upper(c_mktsegment) AND length(c_mktsegment) BETWEEN 1 AND 64 AS topic_ok, length(c_name) BETWEEN 1 AND 128 AND NOT regexp_matches(c_name, '\\s') AS entity_ok, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 1 THEN 1 ELSE c_acctbal END AS FLOAT) AS confidence FROM customer".replace("\\\\s", "\\s"))
def vocabulary_checks(spark, d):
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), V.is_topic(F.col("c_mktsegment")).alias("topic_ok"), V.is_entity_id(F.col("c_name")).alias("entity_ok"), V.clamped_confidence(F.col("c_acctbal")).alias("confidence"))


# --- extraction and drafts: X1, X4, X7, X11, X16, X18, X20, X21, V1-V5 ----------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, CAST(NULL AS VARCHAR) AS error, 'json:$.k' AS selector_path FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, NULLIF(regexp_extract(props, '([0-9]{2,})', 1), ''), CASE WHEN regexp_matches(props, '([0-9]{2,})') THEN NULL ELSE 'no match' END, 'regex:([0-9]{2,})' FROM events WHERE user_id % 2 = 1")
def extracted_scalars(spark, d):
    recipes = spark.createDataFrame([(0, "json_path", "$.k", None, 0), (1, "regex_capture", "([0-9]{2,})", None, 1)], "recipe_id long, mode string, path string, attribute string, grp int")
    payloads = B.table(spark, d, "events").select("event_id", (F.col("user_id") % 2).alias("recipe_id"), F.col("props").alias("payload"))
    return X.apply_recipes(payloads, F.broadcast(recipes)).select("event_id", "value", "error", "selector_path")


@query("SELECT o_orderkey AS id, CAST(i AS INT) AS item_index, 's' || (o_orderkey + i) AS name, CAST(NULL AS VARCHAR) AS error FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, 'no match' FROM orders WHERE o_orderkey % 3 = 0")
def iterated_records(spark, d):
    item = lambda i: F.concat(F.lit('{"name":"s'), F.col("o_orderkey") + i, F.lit('"}'))
    j = F.concat(F.lit('{"storms":['), F.when(F.col("o_orderkey") % 3 != 0, F.concat_ws(",", item(0), item(1))).otherwise(""), F.lit("]}"))
    rows = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), j.alias("payload"))
    return X.json_records(rows, "payload", "$.storms", {"name": "$.name"}).select("id", "item_index", "name", "error")


@query(None)
def selected_markup(spark, d):
    return B.table(spark, d, "pages").select("page_id", X.css_select(F.col("html"), F.lit("article h1"), F.lit(None).cast("string")).alias("r"), X.css_select(F.col("html"), F.lit("nav a"), F.lit("href")).alias("a")).select("page_id", F.col("r.value").alias("title"), F.col("a.value").alias("first_link"), "r.error")


@query("SELECT n_nationkey AS id, CAST(n_nationkey * 10 AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM nation")
def csv_cells(spark, d):
    text = F.concat(F.lit("country, production\nx, 1\n"), "n_name", F.lit(", "), F.col("n_nationkey") * 10, F.lit("\n"))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), X.csv_cell(text, F.lit("production"), F.lit("country"), F.col("n_name")).alias("r")).select("id", "r.value", "r.error")


@query("SELECT n_nationkey AS id, CAST(n_nationkey AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM nation")
def table_cells(spark, d):
    page = F.concat(F.lit("Title\n\nname  tons\n"), F.lit("a  "), "n_nationkey", F.lit("\n"))
    spot = F.array(F.lit(2), F.lit(0), F.lit(1), F.lit(1))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), X.table_cell(F.array(F.lit("first"), page), spot).alias("r")).select("id", "r.value", "r.error")


@query("SELECT s_suppkey AS id, 'https://x.org/odata/t?$top=' || least(s_suppkey * 100, 500) || '#f' AS url FROM supplier")
def capped_pages(spark, d):
    url = F.concat(F.lit("https://x.org/odata/t?$top="), F.col("s_suppkey") * 100, F.lit("#f"))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.capped_page(url, 500).alias("url"))


@query(oracle("recipes", "SELECT recipe_id, array_to_string(list_filter([CASE WHEN slot % 4 < 1 THEN 'no_binding' END, CASE WHEN slot % 4 > 2 THEN 'too_many_bindings' END, CASE WHEN slot % 4 > 2 THEN 'duplicate_expectation' END, CASE WHEN version = 2 THEN 'inner_mode' END, CASE WHEN slot % 3 = 0 THEN 'dedup_field' END], lambda x: x IS NOT NULL), ',') AS violations FROM recipes"))
def recipe_violations(spark, d):
    r = B.recipes(spark, d)
    n = F.col("slot") % 4
    rows = r.select(
        "recipe_id", F.lit("css_select").alias("mode"), F.lit(None).cast("string").alias("iterator_mode"), F.when(F.col("version") == 2, "json_path").when(F.col("version") == 3, "css_select").alias("inner_mode"), n.alias("n_bindings"), F.lit(2).alias("max_bindings"), F.least(n, F.lit(2)).alias("n_distinct"),
        F.lit(False).alias("has_both"), F.when(F.col("slot") % 3 == 0, "gone").otherwise("name").alias("dedup_field"), F.array(F.lit("name"), F.lit("value")).alias("fields"),
    )
    return X.recipe_violations(rows).select("recipe_id", F.array_join("violations", ",").alias("violations"))


@query(oracle("claims", "SELECT id, CAST(least(greatest(confidence, 0), 1) AS FLOAT) AS confidence FROM claims WHERE id % 4 <> 0 AND kind IN ('click', 'purchase')"))
def valid_assertions(spark, d):
    drafts = B.claims(spark, d).select("id", F.concat(F.lit(" "), "claimant").alias("claimant"), F.col("rel_from").alias("subject"), F.when(F.col("id") % 4 == 0, F.lit("bad id")).otherwise(F.col("rel_to")).alias("object"), F.col("kind").alias("predicate"), F.lit("reported").alias("stance"), "confidence")
    return DOC.valid_assertions(drafts, ["click", "purchase"]).select("id", "confidence")


@query(oracle("claims", "SELECT id, CASE WHEN id % 2 = 0 THEN 'context' END AS direction FROM claims WHERE kind = 'click' AND id % 5 <> 0"))
def valid_events(spark, d):
    i = F.col("id")
    drafts = B.claims(spark, d).select("id", F.col("kind").alias("event_type"), F.lit("headline").alias("headline"), F.array(F.lit(" "), F.when(i % 5 == 0, F.lit("a b")).otherwise(F.col("rel_from"))).alias("actors"), F.when(i % 2 == 0, "context").otherwise("sideways").alias("direction"))
    return DOC.valid_events(drafts, ["click"]).select("id", "direction")


@query(oracle("observations", "SELECT seq, CASE WHEN seq % 2 = 0 THEN 'USD' END AS currency FROM observations WHERE metric = 'NO' AND seq % 3 <> 0"))
def valid_observations(spark, d):
    s = F.col("seq")
    drafts = B.observations(spark, d).select("seq", "metric", F.lit("t").alias("unit"), F.when(s % 3 == 0, "hourly").otherwise("annual").alias("period"), F.when(s % 2 == 0, "USD").otherwise("usd").alias("currency"))
    return DOC.valid_observations(drafts, ["NO"]).select("seq", "currency")


# --- dashboard: D1-D3, D6, D7, D13, D15, W7, W9, J15, J17, T1 -------------------------------


@query(oracle("observations", "SELECT metric, latest, previous, round(latest - previous, 4) AS delta, CAST(sign(latest - previous) AS BIGINT) AS direction FROM (SELECT metric, value AS latest, lag(value) OVER w AS previous, row_number() OVER (PARTITION BY metric ORDER BY valid_at DESC, seq DESC) AS r FROM o WINDOW w AS (PARTITION BY metric ORDER BY valid_at, seq)) WHERE r = 1", "o AS (SELECT DISTINCT ON (metric, valid_at, seq, value) metric, valid_at, seq * 1000000 + part AS seq, value FROM observations)"))
def latest_observations(spark, d):
    o = B.observations(spark, d).select("metric", "valid_at", (F.col("seq") * 1000000 + F.col("part")).alias("seq"), "value").dropDuplicates(["metric", "valid_at", "seq", "value"])
    return D.latest_and_delta(o, "metric", "valid_at", "value", "seq").withColumn("delta", F.round("delta", 4))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE c <= 200 OR list_contains(list_transform(range(0, 200), lambda k: CAST(floor(k * (c - 1) / 199 + 0.5) AS BIGINT)), i) GROUP BY 1")
def thinned_series(spark, d):
    return D.thinned(B.table(spark, d, "events"), "event_type", ["ts", "event_id"], 200).groupBy("event_type").agg(F.count("*").alias("n"))


@query(oracle("claims", "SELECT id, kind, turn FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY observed_at, id) AS turn FROM claims) ORDER BY turn, CASE kind WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, kind LIMIT 40"))
def interleaved_buckets(spark, d):
    return D.interleaved(B.claims(spark, d), "kind", ["observed_at", "id"], {"purchase": 0, "signup": 1}, 40).select("id", "kind", F.col("turn").cast("long").alias("turn"))


@query(oracle("observations", "SELECT metric, round(min(value) - (max(value) - min(value)) * 0.05, 4) AS lo, round(max(value) + (max(value) - min(value)) * 0.05, 4) AS hi FROM observations GROUP BY 1"))
def chart_domains(spark, d):
    return D.chart_domain(B.observations(spark, d), "metric", "value").select("metric", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(oracle("outcomes", "SELECT CASE kind WHEN 'succeeded' THEN 'good' WHEN 'declined' THEN 'muted' WHEN 'failed' THEN 'bad' ELSE 'neutral' END AS tone, count(*) AS n FROM outcomes GROUP BY 1"))
def outcome_tones(spark, d):
    return B.outcomes(spark, d).groupBy(D.outcome_tone(F.col("kind")).alias("tone")).agg(F.count("*").alias("n"))


@query(oracle("plans recipes", "SELECT coalesce(e.plan_id, r.plan_id) AS plan_id, coalesce(e.idx, r.idx) AS idx, coalesce(label, '') AS label, coalesce(recipes, '') AS recipes FROM (SELECT plan_id, i AS idx, topic || i AS label FROM plans, (SELECT unnest(range(0, 12)) AS i)) e FULL JOIN (SELECT plan_id, slot AS idx, string_agg(recipe_id, ',' ORDER BY recipe_id) AS recipes FROM recipes GROUP BY 1, 2) r ON r.plan_id = e.plan_id AND r.idx = e.idx"))
def expectation_coverage(spark, d):
    expected = B.plans(spark, d).select("plan_id", F.lit("metric").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("idx"), "topic").withColumn("label", F.concat("topic", "idx")).drop("topic")
    bound = B.recipes(spark, d).select("plan_id", F.lit("metric").alias("bucket"), F.col("slot").alias("idx"), "recipe_id")
    return D.coverage(expected, bound).select("plan_id", "idx", "label", F.array_join("recipes", ",").alias("recipes"))


@query(oracle("recipes", "SELECT root, depth, recipe_id FROM l WHERE depth < 32", "r AS (SELECT recipe_id, version, CASE WHEN CAST(right(recipe_id, 12) AS BIGINT) % 20 = 0 THEN NULL ELSE uu(CAST(right(recipe_id, 12) AS BIGINT) - 1) END AS prior FROM recipes), l(root, depth, recipe_id, prior) AS (SELECT recipe_id, 0, recipe_id, prior FROM r WHERE version = 3 UNION ALL SELECT l.root, l.depth + 1, r.recipe_id, r.prior FROM l JOIN r ON r.recipe_id = l.prior WHERE l.depth < 31)", recursive=True))
def recipe_lineage(spark, d):
    n = F.right("recipe_id", F.lit(12)).cast("long")
    r = B.recipes(spark, d).withColumn("prior", F.when(n % 20 != 0, B.uu(n - 1)))
    return S.lineage(r, "recipe_id", "prior", start="version = 3").select("root", "depth", F.col("id").alias("recipe_id"))


_ATTEMPTS = """a AS (SELECT 'h' || (user_id % 50) AS host, ts AS tm, event_type = 'error' AS failed, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 3000 END AS retry_after, event_id AS seq FROM events),
b AS (SELECT *, (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AS now FROM a), r AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY host ORDER BY tm, seq) AS run FROM b WHERE tm <= now),
c AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY host, run ORDER BY tm, seq) AS failures FROM r), w AS (SELECT *, struct_pack(a := tm, s := seq) AS o, CAST(coalesce(retry_after, least(60, 2 ** least(failures - 1, 6))) AS BIGINT) AS wait FROM c),
l AS (SELECT host, max_by(failures, o) AS failures, max_by(wait, o) FILTER (WHERE failed) AS wait, max_by(tm, o) FILTER (WHERE failed) AS tm, max(now) AS now FROM w GROUP BY 1)"""


@query("WITH " + _ATTEMPTS + " SELECT host, CAST(failures AS INT) AS failures, coalesce(wait, 0) AS wait, CASE WHEN tm + to_seconds(wait) > now THEN 'blocked' WHEN failures > 0 THEN 'recovering' ELSE 'clean' END AS state FROM l")
def backoff_states(spark, d):
    """The state of each host half an hour before the last event."""
    events = B.table(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 50).alias("host"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, 3000)).alias("retry_after"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("seq"))
    now = events.agg((F.max("at") - F.expr("INTERVAL 30 MINUTES")).alias("now")).first()["now"]
    return host_backoff(events, F.lit(now)).select("host", "failures", "wait", "state")
