"""Entities by tier of their license, exemplars, and clean-up after rejected plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V


def tier(license: Column) -> Column:
    return F.when(license == "extracted", 3).when(license == "classifier-emitted", 2).when(license == "unknown", 1).otherwise(0)


def tiered_upsert(rows: DataFrame) -> DataFrame:
    """One row per entity_id: what names it comes from the first row of the highest tier, what dates it from the first row."""
    rank = F.struct(tier(F.col("license")).alias("t"), (-F.col("seq")).alias("s"))
    first, best = F.struct("seq", "score", "nation"), F.struct("kind", "canonical_name", "license")
    found = rows.groupBy("entity_id").agg(F.min_by(first, "seq").alias("first"), F.max_by(best, rank).alias("best"), F.count("*").alias("n_rows"))
    return found.select("entity_id", "first.seq", "first.score", "first.nation", "best.kind", "best.canonical_name", "best.license", tier(F.col("best.license")).cast("long").alias("tier"), "n_rows")


def refresh_log(rows: DataFrame) -> DataFrame:
    """Rows that raised the tier of their entity, with the tier and name before."""
    w = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = tier(F.col("license"))
    with_before = rows.withColumn("new_tier", t).withColumn("old_tier", F.max("new_tier").over(w)).withColumn("old_name", F.max_by("canonical_name", F.struct("new_tier", -F.col("seq"))).over(w))
    raised = with_before.filter("old_tier IS NOT NULL AND new_tier > old_tier")
    return raised.select("entity_id", "seq", "old_tier", "new_tier", (F.col("canonical_name") != F.col("old_name")).alias("name_changed"))


def materialized(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """What becomes of each exemplar row (entity_id, license, seq) beside the entities that exist (entity_id, license): materialized, refreshed, skipped or error.

    The first row of a new entity is materialized, and the first that raises a tier refreshes; an id that is none is an error.
    """
    old = entities.groupBy("entity_id").agg(F.max(tier(F.col("license"))).alias("_old"))
    w = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = tier(F.col("license"))
    before = rows.withColumn("_tier", t).withColumn("_before", F.max("_tier").over(w)).join(old, "entity_id", "left")
    known = F.greatest("_before", "_old")
    outcome = F.when(~F.coalesce(V.is_entity_id(F.col("entity_id")), F.lit(False)), "error").when(known.isNull(), "materialized").when(F.col("_tier") > known, "refreshed").otherwise("skipped")
    return before.withColumn("outcome", outcome).drop("_tier", "_before", "_old")


def exemplar_name(entity_id: Column) -> Column:
    """The part after the first colon, if there is one, with blanks for underscores."""
    rest = F.regexp_extract(entity_id, "^[^:]*:(.+)$", 1)
    return F.translate(F.when(rest != "", rest).otherwise(entity_id), "_", " ")


def entity_exemplars(plans: DataFrame) -> DataFrame:
    """Rows for every exemplar of a plan's entity_kinds (array of struct kind, ids); blank kinds are left out."""
    each = plans.select("plan_id", F.explode("entity_kinds").alias("k")).select("plan_id", F.trim("k.kind").alias("kind"), F.explode("k.ids").alias("entity_id")).filter("kind <> ''")
    return each.select("entity_id", "kind", exemplar_name(F.col("entity_id")).alias("canonical_name"), F.lit("classifier-emitted").alias("license"), F.concat(F.lit("plan:"), "plan_id", F.lit("#entity_exemplar")).alias("source_id"))


def relation_exemplars(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows for every pair of a plan's relation_kinds (array of struct kind, pairs) that is not there yet."""
    each = plans.select("plan_id", F.explode("relation_kinds").alias("k")).select("plan_id", F.trim("k.kind").alias("kind"), F.explode("k.pairs").alias("p")).filter("kind <> ''")
    key = F.concat(F.lit("plan:"), "plan_id", F.lit("#relation_exemplar:"), F.concat_ws(":", "kind", "p.from", "p.to"))
    return each.select(key.alias("dedup_key"), "kind", F.col("p.from").alias("rel_from"), F.col("p.to").alias("rel_to")).dropDuplicates(["dedup_key"]).join(existing, "dedup_key", "left_anti")


def rewired(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """Entities of rejected plans moved to the earliest accepted plan that names them; those that none names are dropped.

    entities: entity_id, plan_id.  plans: plan_id, status, seq, ids (entity ids that the plan names).
    """
    named = plans.filter("status = 'accepted'").select(F.col("plan_id").alias("new_plan"), "seq", F.explode("ids").alias("entity_id"))
    earliest = named.groupBy("entity_id").agg(F.min_by("new_plan", F.struct("seq", "new_plan")).alias("new_plan"))
    rejected = plans.filter("status = 'rejected'").select("plan_id", F.lit(True).alias("gone"))
    both = entities.join(rejected, "plan_id", "left").join(earliest, "entity_id", "left")
    return both.filter("gone IS NULL OR new_plan IS NOT NULL").select("entity_id", F.when(F.col("gone"), F.col("new_plan")).otherwise(F.col("plan_id")).alias("plan_id"), F.coalesce("gone", F.lit(False)).alias("rewired"))
