"""Claims and their promotion to facts: triples, quorums, registry, idempotent promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python_udfs import canonical_json
from ..functions.vocab import clamped_confidence

TRIPLE = ("kind", "rel_from", "rel_to")
DEFAULT_QUORUM = 3


def triple_universe(claims: DataFrame) -> DataFrame:
    """Distinct claimants and claims of each triple."""
    return claims.groupBy(*TRIPLE).agg(F.countDistinct("claimant").alias("n_claimants"), F.count("*").alias("n_claims"))


def triple_histogram(claims: DataFrame) -> DataFrame:
    return triple_universe(claims).groupBy("n_claimants").agg(F.count("*").alias("n_triples"), F.sum("n_claims").alias("n_claims"))


def quorum(claims: DataFrame, least: int) -> DataFrame:
    """Triples with so many claimants and their sorted names."""
    found = claims.groupBy(*TRIPLE).agg(F.array_sort(F.collect_set("claimant")).alias("claimants"), F.count("*").alias("n_claims"))
    return found.filter(F.size("claimants") >= least).withColumn("n_claimants", F.size("claimants").cast("long"))


def source_diversity(claims: DataFrame) -> DataFrame:
    """Per kind: triples by one, two, and three or more claimants."""
    n = F.col("n_claimants")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
    return triple_universe(claims).groupBy("kind").agg(count(n == 1)("singletons"), count(n == 2)("pairs"), count(n >= 3)("quorums"), F.count("*").alias("triples"))


def claimants_over_triple(claims: DataFrame) -> DataFrame:
    """Each claim with the distinct claimants of its triple (a window cannot count distinct rows)."""
    w = Window.partitionBy(*TRIPLE)
    return claims.select("*", F.size(F.collect_set("claimant").over(w)).cast("long").alias("n_claimants"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PREFIX = "^(agency|publisher|source):"


def small(c: Column) -> Column:
    """ASCII letters made small, all others as they are."""
    return F.translate(c, _CAPITALS, _SMALL)


def claimant_keys(claimant: Column) -> Column:
    """The names under which a registry may list a claimant: as it is, and without a known prefix (which is written small)."""
    return F.array_distinct(F.array(small(claimant), small(F.regexp_replace(claimant, _PREFIX, ""))))


def registry_keys(claimant: Column, metric: Column, topics: Column) -> Column:
    """Every key under which an entry for a claim may stand: its claimant's names, with its metric or any, with one of its topics or any."""
    topic = F.array_append(F.array_distinct(F.coalesce(topics, F.array().cast("array<string>"))), F.lit(None).cast("string"))
    pairs = F.transform(F.array(metric, F.lit(None).cast("string")), lambda m: F.transform(topic, lambda t: F.struct(m.alias("metric"), t.alias("topic"))))
    return F.flatten(F.transform(claimant_keys(claimant), lambda c: F.transform(F.flatten(pairs), lambda p: F.struct(c.alias("claimant"), p["metric"].alias("metric"), p["topic"].alias("topic")))))


def registry_entries(registry: DataFrame) -> DataFrame:
    """One row for each claimant, metric and topic (null: any) of a registry: whether it lets a claim pass alone, and the least quorum it sets."""
    has_metric = "metric" in registry.columns
    entry = registry.select(small(F.col("claimant")).alias("claimant"), (F.col("metric") if has_metric else F.lit(None).cast("string")).alias("metric"), "topic", "quorum")
    quorum = F.min(F.when(F.col("quorum") >= 1, F.col("quorum")))
    return entry.filter(F.trim("claimant") != "").groupBy("claimant", "metric", "topic").agg(F.max(F.coalesce("quorum", F.lit(1)) <= 1).alias("entry_alone"), quorum.alias("entry_quorum"))


def with_registry(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims (claimant, metric, topics) with ``alone`` (an entry lets them pass by themselves) and ``lowered`` (the least quorum that an entry sets).

    Each distinct claimant, metric and topics is looked up once, under all its keys; nulls are keys.
    """
    of = ["claimant", "metric", "topics"]
    asked = claims.select(*of).distinct().select(*of, F.explode(registry_keys(*map(F.col, of))).alias("k"))
    entries = registry_entries(registry).alias("e")
    hit = asked.join(entries, F.expr("k.claimant = e.claimant AND k.metric <=> e.metric AND k.topic <=> e.topic")).select(*[asked[c] for c in of], "entry_alone", "entry_quorum")
    found = hit.groupBy(*of).agg(F.max("entry_alone").alias("alone"), F.min("entry_quorum").alias("lowered")).alias("f")
    same = F.expr("c.claimant <=> f.claimant AND c.metric <=> f.metric AND c.topics <=> f.topics")
    return claims.alias("c").join(found, same, "left").select("c.*", F.coalesce("f.alone", F.lit(False)).alias("alone"), F.col("f.lowered").alias("lowered"))


def content_hash(claim: tuple[str, ...] = TRIPLE) -> Column:
    """First 128 bits of the hash of the canonical JSON of a relation (kind, from, to)."""
    kind, start, end = (F.coalesce(c, F.lit("")) for c in claim)
    text = F.to_json(F.struct(F.lit("relation").alias("asserted_kind"), start.alias("from"), kind.alias("kind"), end.alias("to")))
    return F.substring(F.sha2(text, 256), 1, 32)


def asserted(kind: Column, content: Column) -> Column:
    """Canonical JSON of what is asserted, from the JSON of its fields: keys in order, floats in their shortest form, and null for the fields of a kind that are always written."""
    always = F.when(kind == "observation", F.lit('"value_uncertainty":null,"currency":null,')).when(kind == "event", F.lit('"direction":null,')).otherwise(F.lit(""))
    own = F.regexp_replace(content, r"\A\s*\{\s*", "")
    # Of members of one name the last counts, so that what the content says comes after.
    return canonical_json(F.concat(F.lit('{"asserted_kind":"'), kind, F.lit('",'), F.when(own == "}", F.regexp_replace(always, ",$", "")).otherwise(always), own))


def asserted_hash(kind: Column, content: Column) -> Column:
    """First 128 bits of the hash of an asserted observation, event, relation or entity attribute; null if its content is no JSON."""
    return F.substring(F.sha2(asserted(kind, content), 256), 1, 32)


def subject_hash(topics: Column, entities: Column) -> Column:
    lines = lambda mark, c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")
    return F.substring(F.sha2(F.concat(lines("t:", topics), lines("e:", entities)), 256), 1, 32)


def judged(claims: DataFrame, registry: DataFrame, topics: tuple[str, ...] = ()) -> DataFrame:
    """Claims with the key of their group and what the registry says of them.

    A claim without columns ``topics`` and ``metric`` has the topics given, and its kind as its metric.
    """
    own = claims if "topics" in claims.columns else claims.withColumn("topics", F.array(*[F.lit(t) for t in topics]).cast("array<string>"))
    own = own if "metric" in own.columns else own.withColumn("metric", F.col("kind"))
    keyed = own if "content_hash" in own.columns else own.withColumn("content_hash", content_hash())
    keyed = keyed.withColumn("subject_hash", subject_hash(F.col("topics"), F.array("rel_from", "rel_to")))
    return with_registry(keyed.withColumn("dedup_key", F.concat_ws(":", F.lit("promotion"), "content_hash", "subject_hash")), registry)


def promoted_groups(claims: DataFrame, least: int = DEFAULT_QUORUM) -> DataFrame:
    """Facts from judged claims, one aggregation by group: by the newest claim that may pass alone, else by enough claimants of the others."""
    alone, order = F.col("alone"), F.struct("observed_at", "id")
    of = lambda test, c: F.when(test, c)
    newest = F.struct("id", "source_id", "confidence")
    groups = claims.groupBy("dedup_key", *TRIPLE).agg(
        F.max_by(newest, of(alone, order)).alias("said"), F.max_by(newest, of(~alone, order)).alias("last"), F.countDistinct(of(~alone, F.col("claimant"))).alias("claimants"), F.count(of(~alone, F.lit(1))).alias("claims"),
        F.avg(of(~alone, F.col("confidence"))).alias("mean"), F.min(of(~alone, F.col("lowered"))).alias("lowered"), F.max(alone).alias("by_authority"),
    )
    needed = F.least(F.lit(least), F.coalesce("lowered", F.lit(least)))
    either = lambda a, b: F.when(F.col("by_authority"), a).otherwise(b)
    return groups.filter(F.col("by_authority") | (F.col("claimants") >= needed)).select(
        "dedup_key", *TRIPLE, either(F.lit(1).cast("long"), F.col("claimants")).alias("n_claimants"), either(F.lit(1).cast("long"), F.col("claims")).alias("n_support"), either(F.col("said.source_id"), F.col("last.source_id")).alias("representative"),
        either(F.col("said.id"), F.col("last.id")).alias("representative_id"), clamped_confidence(either(F.col("said.confidence").cast("double"), F.col("mean"))).alias("confidence"),
        either(F.lit("derived#authoritative"), F.lit("derived#consensus")).alias("source_id"),
    )


def promote(claims: DataFrame, registry: DataFrame, promoted: DataFrame, topics: tuple[str, ...], least: int = DEFAULT_QUORUM) -> DataFrame:
    """Facts newly promoted: by an authoritative claimant alone, or by so many claimants.

    registry: claimant, topic (null: any), quorum (null: 1), and metric (null: any) if it has one; an
    entry at 1 promotes alone and its claims, promoted now or before, leave the consensus; a larger
    one lowers the needed number for the groups that hold a claim it fits.  A fact by authority
    rests on the newest claim alone.  promoted: dedup_key of facts that exist; they are not made
    again, in any plan.  Stance is no part of a group, so a denial supports the claim that it denies.
    """
    return promoted_groups(judged(claims, registry, topics), least).join(promoted.select("dedup_key"), "dedup_key", "left_anti")


def support_edges(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """child_id, parent_id and role of the judged claims that each fact rests on."""
    by = facts.select(F.col("dedup_key").alias("child_id"), "representative_id", (F.col("source_id") == "derived#authoritative").alias("by_authority"))
    said = by.filter("by_authority").select("child_id", F.col("representative_id").alias("parent_id"), F.lit("promotion").alias("role"))
    agreed = claims.filter("NOT alone").select(F.col("dedup_key").alias("child_id"), F.col("id").alias("parent_id")).join(by.filter("NOT by_authority").select("child_id"), "child_id")
    return said.unionByName(agreed.withColumn("role", F.lit("consensus_support")))


def promotion_report(facts: DataFrame, claims: DataFrame) -> DataFrame:
    n = facts.agg(
        F.count("*").alias("promoted"), F.count(F.when(F.col("source_id") == "derived#authoritative", 1)).alias("authoritative"), F.count(F.when(F.col("source_id") == "derived#consensus", 1)).alias("consensus"),
        F.coalesce(F.sum("n_support"), F.lit(0)).cast("long").alias("supporting"),
    )
    return n.crossJoin(F.broadcast(claims.agg(F.count("*").alias("considered"))))


def unpromoted(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims that no promotion rests on."""
    used = edges.filter(F.col("role").isin("promotion", "consensus_support")).select(F.col("parent_id").alias("id"))
    return claims.join(used, "id", "left_anti")
