"""Sums over the recent past: sliding windows of event time, over a table or over a stream with late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_sums(rows: DataFrame, at: str, key: str, value: str, length: str, slide: str, late: str | None = None) -> DataFrame:
    """Number and sum of the values of each key in every window (from, until) of so much event time.

    Over a stream, ``late`` is how far the watermark stays behind the newest row: a window is
    given out once, when the watermark has passed its end, and rows that come after that are left
    out (``in_time`` is the same rule over a table).
    """
    timed = rows.withWatermark(at, late) if late else rows
    w = F.window(F.col(at), length, slide)
    sums = timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("from"), F.col("w.end").alias("until"), key, "n", "total")


def in_time(rows: DataFrame, at: str, batch: str, late: Column) -> DataFrame:
    """Rows of consecutively numbered batches, each with ``closed``: up to where windows have been given out when its batch is read.  A window that ends by then takes no more rows.

    A batch gives out what the batches before it have closed, so the next one cannot add to it:
    ``closed`` comes from all batches but the last one before.  There is one row for a batch.
    """
    newest = rows.groupBy(batch).agg(F.max(at).alias("_newest"))
    before = newest.alias("b").join(newest.alias("a"), F.expr(f"a.{batch} < b.{batch} - 1"), "left").groupBy(F.col(f"b.{batch}").alias(batch)).agg((F.max("a._newest") - late).alias("closed"))
    return rows.join(F.broadcast(before), batch)
