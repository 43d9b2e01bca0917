"""Dashboard transforms: groups, latest values, thinning of series, fair interleaving, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_kind(records: DataFrame, kind: str) -> DataFrame:
    return records.groupBy(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("(unknown)")).alias("kind")).agg(F.count("*").alias("n"))


def latest_and_delta(series: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Per key: last value, the one before, their difference and its sign."""
    w = Window.partitionBy(key).orderBy(at, tie)
    stepped = series.select(key, at, tie, F.col(value).alias("v"), F.lag(value).over(w).alias("previous"))
    last = stepped.groupBy(key).agg(F.max_by(F.struct("v", "previous"), F.struct(at, tie)).alias("x"))
    delta = F.col("x.v") - F.col("x.previous")
    return last.select(key, F.col("x.v").alias("latest"), F.col("x.previous").alias("previous"), delta.alias("delta"), F.signum(delta).cast("long").alias("direction"))


def thinned(series: DataFrame, key: str, order: list[str], points: int) -> DataFrame:
    """At most so many evenly spaced rows of each series, the first and last among them."""
    w = Window.partitionBy(key)
    n = series.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (points - 1) + 0.5)))
    return n.filter((F.col("_n") <= points) | F.array_contains(spots, F.col("_i").cast("long"))).drop("_i", "_n")


def interleaved(rows: DataFrame, bucket: str, order: list[str], ranks: dict[str, int], cap: int) -> DataFrame:
    """Buckets in turn, one row each, until the cap."""
    rank = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(r)) for b, r in ranks.items()], F.lit(len(ranks)))
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("turn", turn).withColumn("_rank", rank).orderBy("turn", "_rank", bucket).limit(cap).drop("_rank")


def coverage(expected: DataFrame, bound: DataFrame) -> DataFrame:
    """Expectations (plan_id, bucket, idx, label) with the recipes bound to them; bindings without an expectation have an empty label."""
    recipes = bound.groupBy("plan_id", "bucket", "idx").agg(F.array_sort(F.collect_list("recipe_id")).alias("recipes"))
    both = expected.join(recipes, ["plan_id", "bucket", "idx"], "full_outer")
    return both.select("plan_id", "bucket", "idx", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("recipes", F.expr("array()").cast("array<string>")).alias("recipes"))


def heatmap(outcomes: DataFrame, runs: int) -> DataFrame:
    """Outcomes of each recipe in each of the latest runs, run1 the newest; a recipe with outcomes in older runs alone has zeros."""
    newest = outcomes.groupBy("run_id").agg(F.max("attempted_at").alias("at")).orderBy(F.desc("at"), "run_id").limit(runs)
    places = newest.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), "run_id"))).alias("r")).select(F.posexplode("r").alias("place", "x")).select("x.run_id", (F.col("place") + 1).alias("place"))
    cells = outcomes.select("recipe_id", "run_id").join(places, "run_id", "left").groupBy("recipe_id").pivot("place", list(range(1, runs + 1))).agg(F.count(F.lit(1)))
    return cells.select("recipe_id", *[F.coalesce(F.col(str(r)), F.lit(0)).cast("long").alias(f"run{r}") for r in range(1, runs + 1)])


def chart_domain(df: DataFrame, key: str, value: str) -> DataFrame:
    lo, hi = F.min(value).alias("lo"), F.max(value).alias("hi")
    pad = (F.col("hi") - F.col("lo")) * 0.05
    return df.groupBy(key).agg(lo, hi).select(key, (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def outcome_tone(kind: Column) -> Column:
    return F.when(kind == "succeeded", "good").when(kind == "declined", "muted").when(kind == "failed", "bad").otherwise("neutral")
