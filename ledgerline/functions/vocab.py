"""Predicates for the validated scalar types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies.
STANCES = ("asserted", "hedged", "denied", "reported", "predicted", "speculated")
PERIODS = ("instant", "daily", "weekly", "monthly", "quarterly", "annual")
DIRECTIONS = ("supply_positive", "supply_negative", "demand_positive", "demand_negative", "context")


def is_topic(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def is_country(c: Column) -> Column:
    return c.rlike(r"\A[A-Z]{2}\z")


def is_entity_id(c: Column) -> Column:
    return F.octet_length(c).between(1, 128) & ~c.rlike(r"(?U)[\s\p{Cntrl}]")


def is_event_type(c: Column) -> Column:
    return c.rlike(r"\A[a-z0-9_]{1,64}\z")


def is_unit(c: Column) -> Column:
    return F.octet_length(c).between(1, 32) & ~c.rlike(r"(?U)[\s\p{Cntrl}]")


def is_currency(c: Column) -> Column:
    return c.rlike(r"\A[A-Z]{3}\z")


def clamped_confidence(c: Column) -> Column:
    """Into [0, 1] as a float; what is not finite becomes 0."""
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.least(d, F.lit(1.0)), F.lit(0.0))).cast("float")


def user_text(c: Column) -> Column:
    """Line ends made one way; null if control, zero-width or direction characters are left."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    return F.when(~t.rlike("[\\x00-\\x08\\x0B-\\x1F\\x7F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u2069\\uFEFF]"), t)


def valid_position(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))
