"""Updates and deletes as snapshots: each takes a table and returns the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows whose keys are in gone; rows with a null key stay."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def missing(table: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys do not exist yet, one of each."""
    return table.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def updated(table: DataFrame, where: str, **values: object) -> DataFrame:
    """table with the named columns set in the rows where the condition holds."""
    return table.withColumns({c: F.when(F.expr(where), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def backfilled(edges: DataFrame, key: str, typed: dict[str, DataFrame], column: str = "parent_type") -> DataFrame:
    """The type of each edge's parent: the first table in order that knows its id, else unknown."""
    known = None
    for rank, (name, ids) in enumerate(typed.items()):
        part = ids.select(F.col(key), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("_t"))
        known = part if known is None else known.union(part)
    first = known.groupBy(key).agg(F.min("_t").alias("_t"))
    return edges.join(first, key, "left").withColumn(column, F.coalesce("_t.name", F.lit("unknown"))).drop("_t")


def without_poison(table: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content names its kind under the old tag alone are taken out."""
    get = lambda p: F.get_json_object(content, p)
    return table.filter(~(get("$.asserted_kind").isNull() & get("$.kind").isNotNull()))


def without_dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose parent is in one of the tables."""
    return edges.join(ids.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def seeded(table: DataFrame, seed: DataFrame) -> DataFrame:
    return seed if table.isEmpty() else table
