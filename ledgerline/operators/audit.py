"""Audit history: attempts, outcomes, trims, rolling sums, feedback upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_pivot(outcomes: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan, with none as well: runs, and outcomes of each kind."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(kind)
    per = outcomes.groupBy("plan_id").agg(*[count(k) for k in ("succeeded", "declined", "failed")], F.count("*").alias("total"), F.countDistinct("run_id").alias("runs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return plans.join(per, "plan_id", "left").select("plan_id", "topic", *[zero(c) for c in ("succeeded", "declined", "failed", "total", "runs")])


def sources_memory(recipes: DataFrame, attempts: DataFrame, plans: DataFrame, limit: int = 30) -> DataFrame:
    """Sources that ever worked: successes, last success, topics of their plans; best first."""
    per = attempts.groupBy("recipe_id").agg(F.count(F.when(F.col("succeeded"), 1)).alias("n"), F.max(F.when(F.col("succeeded"), F.col("attempted_at"))).alias("last"))
    found = per.join(recipes, "recipe_id").join(plans, "plan_id").groupBy("source_id").agg(F.sum("n").alias("n_success"), F.max("last").alias("last_success"), F.array_sort(F.collect_set("topic")).alias("topics"))
    return found.filter("n_success > 0").orderBy(F.desc("n_success"), F.desc_nulls_last("last_success"), "source_id").limit(min(limit, 1024))


def parsed_tags(blob: Column) -> Column:
    """Tags of JSON arrays joined by the unit separator: broken parts skipped, blanks dropped, sorted, once each."""
    lists = F.transform(F.split(blob, "\x1f"), lambda x: F.from_json(x, "array<string>"))
    flat = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def trimmed(log: DataFrame, by: str, cap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest cap rows with all ties of the last; per key if keys are given."""
    if cap <= 0:
        return log.limit(0)
    if keys:
        return log.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).filter(F.col("_rank") <= cap).drop("_rank")
    edge = log.select(by).orderBy(F.desc(by)).limit(cap).agg(F.min(by).alias("_edge"))
    return log.join(F.broadcast(edge), F.col(by) >= F.col("_edge")).drop("_edge")


def run_history(outcomes: DataFrame, runs: int) -> DataFrame:
    """Per recipe, the kinds of its outcomes in the plan's latest runs, oldest first."""
    newest = outcomes.groupBy("plan_id", "run_id").agg(F.max("attempted_at").alias("at"))
    newest = newest.withColumn("_rank", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("at"), "run_id"))).filter(F.col("_rank") <= runs)
    cells = outcomes.join(newest.select("plan_id", "run_id"), ["plan_id", "run_id"])
    return cells.groupBy("plan_id", "recipe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempted_at", "id", "kind"))), lambda x: x["kind"]), ",").alias("history"), F.count("*").alias("n"))


def decline_counts(outcomes: DataFrame) -> DataFrame:
    """Declines of each nomination: of itself and of its single expectations."""
    return outcomes.filter("kind = 'declined'").groupBy(F.regexp_extract("source_id", "^(nom:[0-9a-f-]{36})", 1).alias("nomination")).agg(F.count("*").alias("declines"))


def rolling_sum(df: DataFrame, key: str, at: str, value: str, seconds: int) -> DataFrame:
    """Sums over the rows of a key in the seconds up to each row, counted to the microsecond."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("rolling", F.sum(value).over(w))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """table with rows put over it: the last row of each key by seq; null keys are keys."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, F.desc("_new"), F.desc(seq)).drop("_new")


def cost_ledger(calls: DataFrame) -> DataFrame:
    """Sums by provider, tier and purpose in the ledger's order; null tokens add nothing."""
    rank = F.when(F.col("tier") == "frontier", 0).when(F.col("tier") == "workhorse", 1).otherwise(2)
    sums = calls.groupBy("provider", "tier", "purpose").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.count("cached_tokens").alias("cached_calls"))
    ratio = F.when(F.col("input_tokens") > 0, F.greatest(F.least(F.col("cached_tokens") / F.col("input_tokens"), F.lit(1.0)), F.lit(0.0)))
    return sums.withColumn("cache_ratio", ratio).orderBy("provider", rank, F.asc_nulls_first("purpose"))


def host_classes(probes: DataFrame) -> DataFrame:
    """A host's class from the last status of each of its probes (host, agent, status, seq)."""
    last = probes.groupBy("host").pivot("agent", ["plain", "browser", "bot", "none"]).agg(F.max_by("status", "seq"))
    ok = lambda c: F.coalesce(F.col(c).between(200, 399), F.lit(False))
    return last.select("host", F.when(ok("plain"), "open").when(ok("browser"), "browser_only").when(ok("bot") | ok("none"), "bot_only").otherwise("blocked").alias("host_class"))
