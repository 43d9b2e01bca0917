"""The structure inside source ids, parsed once into columns so that later joins are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
RECIPE_REF = rf"^(.*)#recipe:({UUID})@v([0-9]+)$"
PLAN_REF = rf"^plan:({UUID})#(entity_exemplar|relation_exemplar)"
NOMINATION_REF = rf"^nom:({UUID})(?::([^:]*):([0-9]+))?$"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def with_source_key(df: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Adds src_base, recipe_id, recipe_version, plan_ref and origin; parts that a source id lacks are null."""
    s = F.col(source_id)
    origin = (
        F.when(s.rlike(RECIPE_REF), "recipe").when(s.rlike(PLAN_REF), "plan").when(s.startswith("derived#"), "derived").when(s.startswith("nom:"), "nomination").otherwise("other")
    )
    return df.withColumns({
        "src_base": _or_null(F.regexp_extract(s, RECIPE_REF, 1)),
        "recipe_id": _or_null(F.regexp_extract(s, RECIPE_REF, 2)),
        "recipe_version": _or_null(F.regexp_extract(s, RECIPE_REF, 3)).cast("int"),
        "plan_ref": _or_null(F.regexp_extract(s, PLAN_REF, 1)),
        "origin": origin,
    })


def decline_shape(source_id: Column) -> Column:
    """What kind of declined target a source id names."""
    return (
        F.when(source_id.like("nom:%:%:%"), "per_expectation").when(source_id.like("nom:%"), "nomination_level").when(source_id.like("%#recipe:%"), "recipe_keyed").otherwise("other")
    )


def recipe_dedup_key(plan: Column, nomination: Column, bucket: Column, index: Column) -> Column:
    return F.concat_ws(":", plan, nomination, bucket, index)
