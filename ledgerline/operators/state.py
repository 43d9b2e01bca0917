"""Changes of state over several tables: routing of records, clean-up of orphans, registries, plan checks, promoted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from .entities import tiered_upsert

# Bounds of plans and attribute keys, and the entry that an empty registry starts with.
MAX_WINDOW_DAYS, MAX_KEY = 3650, 64
SEED = ("agency:document", None, None, 1)
# Outcomes of a recipe in a run, and stages at which it fails.
OUTCOMES = ("succeeded", "skipped", "failed", "rate_limited", "declined", "legacy_plan_cannot_author")
STAGES = ("fetch", "apply", "insert", "index_page")
REGISTRY_KEY = ("source_id", "metric", "topic")


def routed(records: DataFrame) -> dict[str, DataFrame]:
    """Records by the table that they go to; entities meet their earlier rows there by tier, all else is appended."""
    tables = {t: records.filter(F.col("record_type") == t) for t in ("observation", "event", "relation", "document", "assertion")}
    return tables | {"entity": tiered_upsert(records.filter("record_type = 'entity'"))}


def without_children(children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Junction and edge tables without what hangs on records (id, record_type) that go, as child or as parent."""
    own = gone.select(F.col("id").alias("record_id"), "record_type").distinct()
    out = {c: t.join(own, ["record_id", "record_type"], "left_anti") for c, t in children.items() if c != "derived_from"}
    child = own.select(F.col("record_id").alias("child_id"), F.col("record_type").alias("child_type"))
    parent = own.select(F.col("record_id").alias("parent_id"), F.col("record_type").alias("parent_type"))
    out["derived_from"] = children["derived_from"].join(child, ["child_id", "child_type"], "left_anti").join(parent, ["parent_id", "parent_type"], "left_anti")
    return out


def plan_cleanup(entities: DataFrame, plans: DataFrame, children: dict[str, DataFrame], plan_id: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """After a plan is rejected: its exemplar entities move to the earliest accepted plan that names them, the others go with their edges.

    entities: id, entity_id, source_id.  plans: plan_id, status, created_at, ids (names in its expectations).  Returns
    the entities, the child tables and one row of counters.
    """
    own = F.col("source_id") == F.lit(f"plan:{plan_id}#entity_exemplar")
    named = plans.filter("status = 'accepted'").select("plan_id", "created_at", F.explode("ids").alias("entity_id"))
    heir = named.groupBy("entity_id").agg(F.min_by("plan_id", F.struct("created_at", "plan_id")).alias("heir"))
    both = entities.join(heir, "entity_id", "left")
    gone = both.filter(own & F.col("heir").isNull()).select(F.col("id"), F.lit("entity").alias("record_type"))
    kept = both.filter(~own | F.col("heir").isNotNull()).withColumn("source_id", F.when(own, F.concat(F.lit("plan:"), "heir", F.lit("#entity_exemplar"))).otherwise(F.col("source_id"))).drop("heir")
    after = without_children(children, gone)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    lost = lambda names, name: sum_of([count(children[c], "n").crossJoin(F.broadcast(count(after[c], "m"))).select((F.col("n") - F.col("m")).alias("n")) for c in names], name)
    report = count(gone, "entities_deleted").crossJoin(count(both.filter(own & F.col("heir").isNotNull()), "entities_rewired"))
    report = report.crossJoin(lost([c for c in children if c != "derived_from"], "subject_rows_deleted")).crossJoin(lost(["derived_from"], "derivation_rows_deleted"))
    return kept, after, report


def sum_of(parts: list[DataFrame], name: str) -> DataFrame:
    """One row with the sum of one-row tables of n."""
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.agg(F.sum("n").alias(name))


def registry_upserted(registry: DataFrame, entries: DataFrame, seq: str) -> DataFrame:
    """registry with entries put over it by source, metric and topic, where null equals null; the last entry of a key counts, the first row's created_at stays."""
    both = registry.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*REGISTRY_KEY)
    both = both.withColumn("created_at", F.min("created_at").over(w))
    return both.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_new"), F.desc(seq)))).filter("_rank = 1").drop("_rank", "_new")


def plan_errors(plans: DataFrame) -> DataFrame:
    """plan_id and the rules that a plan breaks, in the order in which they are looked at; attribute keys come back trimmed."""
    keys = F.transform("attributes", lambda a: F.trim(a))
    bad = lambda k: (k == "") | (F.length(k) > MAX_KEY) | k.rlike(r"[\p{Cntrl} ]")
    rules = {
        "no topic tag": F.size("topic_tags") < 1, "bad topic tag": F.exists("topic_tags", lambda t: ~V.is_topic(t)), "window under one day": F.col("window_days") < 1, "window too long": F.col("window_days") > MAX_WINDOW_DAYS,
        "bad attribute key": F.exists(keys, bad), "no expectations": F.col("n_expectations") < 1, "blank interpretation": F.trim("interpretation") == "",
    }
    said = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(name)) for name, t in rules.items()]))
    return plans.select("plan_id", said.alias("errors"), keys.alias("attributes"))


def merged_topics(own: Column, plan: Column) -> Column:
    """A record's topics, then those of its plan that it lacks; order and repeats of its own stay."""
    return F.concat(own, F.array_except(plan, own))


def lineage(plans: DataFrame, key: str, parent: str, cap: int = 32, start: str = "true") -> DataFrame:
    """The chain of parents of each row that fits ``start``, newest first (root, depth, id): it ends at a missing parent or the cap; a cycle is an error."""
    chain = plans.sparkSession.sql(
        f"""
        WITH RECURSIVE chain (root, depth, id, next, path) AS (
          SELECT {key}, 0, {key}, {parent}, array({key}) FROM {{first}}
          UNION ALL
          SELECT c.root, c.depth + 1, r.{key}, r.{parent}, array_append(c.path, r.{key}) FROM chain c JOIN {{rows}} r ON r.{key} = c.next
          WHERE c.depth + 1 < {cap} AND NOT array_contains(c.path, c.next))
        SELECT root, depth, id, next, path FROM chain
        """,
        first=plans.filter(start).select(key, parent),
        rows=plans.select(key, parent),
    )
    cycle = F.col("next").isNotNull() & F.array_contains("path", F.col("next"))
    checked = F.when(cycle, F.raise_error(F.concat(F.lit("cycle in the lineage of "), F.col("root").cast("string"))).cast("int")).otherwise(F.col("depth"))
    return chain.select("root", checked.alias("depth"), "id")


def promoted_rows(facts: DataFrame, claims: DataFrame, plan_topics: Column) -> DataFrame:
    """Whole rows of promoted facts: envelope of the claim that represents each, and the table that the row goes to.

    claims: id, asserted_kind, observed_at, content, topics, entities.  Attributes of entities become assertions of the
    promoting agency; observations, events and relations go to their own tables.
    """
    said = claims.select(F.col("id").alias("representative_id"), F.struct("asserted_kind", "observed_at", "content", "topics", "entities").alias("x"))
    newest = facts.select("dedup_key", F.col("source_id").alias("by"), "confidence", "n_support", "representative_id").join(said, "representative_id")
    attribute = F.col("x.asserted_kind") == "entity_attribute"
    agency = F.concat(F.lit("agency:"), F.regexp_replace("by", "^derived#", ""))
    return newest.select(
        "dedup_key", F.when(attribute, "assertion").otherwise(F.col("x.asserted_kind")).alias("record_type"), F.when(attribute, agency).alias("claimant"), F.when(attribute, F.lit("asserted")).alias("stance"), "x.content", "x.observed_at", "x.entities",
        merged_topics(F.col("x.topics"), plan_topics).alias("topics"), F.array(F.concat(F.lit("promotion:"), F.regexp_replace("by", "^derived#", ""))).alias("tags"), F.lit("derived").alias("license"), F.col("by").alias("source_id"), "confidence", "n_support",
    )


def valid_attributes(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts of entity attributes: an allowed key if keys are given, a value of its kind, and a claimant and stance where none is given."""
    kind, value = F.col("value_kind"), F.trim("value")
    fits = F.when(kind == "number", value.try_cast("double").isNotNull()).when(kind == "boolean", value.isin("true", "false")).when(kind == "text", value != "").otherwise(F.lit(False))
    ok = V.is_entity_id(F.col("entity_id")) & (F.trim("key") != "") & fits
    ok = ok & F.trim("key").isin(*keys) if keys else ok
    said = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    return drafts.filter(F.coalesce(ok, F.lit(False))).withColumns({"key": F.trim("key"), "value": value, "claimant": said("claimant", SEED[0]), "stance": said("stance", "asserted")})


def extracted_records(drafts: DataFrame, document: Column) -> DataFrame:
    """Record rows from drafts (record_type, content, names, topics): license extracted, the document as parent, the draft's names as its subjects."""
    edge = F.struct(document.cast("string").alias("parent_id"), F.lit("document").alias("parent_type"), F.lit("extraction").alias("role"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("names", lambda n: F.trim(n)), lambda n: V.is_entity_id(n))))
    return drafts.select("draft_id", "record_type", "content", names.alias("entities"), "topics", F.lit("extracted").alias("license"), F.array(edge).alias("derived_from"))


def run_rollup(outcomes: DataFrame) -> DataFrame:
    """Per run: recipes by outcome and records produced; an outcome or stage that is not known is an error."""
    known = F.col("kind").isin(*OUTCOMES) & (F.col("stage").isNull() | F.col("stage").isin(*STAGES))
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), "kind")))
    counts = [F.count(F.when(F.col("k") == k, 1)).alias(k) for k in OUTCOMES]
    return outcomes.withColumn("k", kind).groupBy("run_id").agg(*counts, F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"))


def merged_reports(reports: DataFrame) -> DataFrame:
    """Counters of several reports added up."""
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in reports.columns])
