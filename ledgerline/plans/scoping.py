"""Which records belong to a plan: equi-joins on parsed source ids instead of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import with_source_key


def records_of_plans(records: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each record once for every plan that it belongs to, through its recipe or named by its source id."""
    keyed = with_source_key(records)
    through = keyed.join(recipes.select("recipe_id", "plan_id").distinct(), "recipe_id")
    named = keyed.filter(F.col("plan_ref").isNotNull()).withColumn("plan_id", F.col("plan_ref"))
    columns = ["plan_id", *records.columns]
    return through.select(*columns).union(named.select(*columns)).distinct()


def counts_by_plan(records: DataFrame, recipes: DataFrame, plans: DataFrame) -> DataFrame:
    n = records_of_plans(records, recipes).groupBy("plan_id").agg(F.count("*").alias("n"))
    return plans.select("plan_id", "topic", "status").join(n, "plan_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def with_status(plans: DataFrame, status: str | None) -> DataFrame:
    return plans.filter(F.col("status") == status) if status else plans
