"""The waiting time of each host after failures: a snapshot of a history, or a stream of changes with timers.

A failure blocks its host for the time that the answer asks for, else for a doubling time; a
success sets the count of failures back and leaves the deadline.  At any instant a host is
*blocked* until its deadline, then *recovering* while it has failures on its count, else *clean*.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LONGEST = 60
SCHEMA = "host string, failures int, wait long, until timestamp, state string, as_of timestamp"


def _wait(failures: int, retry_after: float | None) -> int:
    return int(retry_after) if retry_after is not None and retry_after == retry_after else min(LONGEST, 2 ** min(failures - 1, 6))


def host_backoff(attempts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Failures in a row, last wait, deadline and state of each host (host, at, failed, retry_after, seq) at an instant, or after the last attempt of all.

    Runs of failures are found by built-in windows: only the last failure of a host decides its deadline.
    """
    if as_of is None:
        attempts = attempts.crossJoin(F.broadcast(attempts.agg(F.max("at").alias("_now"))))  # one row
    else:
        attempts = attempts.withColumn("_now", as_of.cast("timestamp")).filter(F.col("at") <= F.col("_now"))
    good = F.count(F.when(~F.col("failed"), 1))
    runs = attempts.withColumn("_run", good.over(Window.partitionBy("host").orderBy("at", "seq")))
    counted = runs.withColumn("failures", F.count(F.when(F.col("failed"), 1)).over(Window.partitionBy("host", "_run").orderBy("at", "seq")).cast("int"))
    wait = F.coalesce(F.col("retry_after").cast("long"), F.least(F.lit(LONGEST), F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(6)))).cast("long"))
    order = F.struct("at", "seq")
    last = counted.withColumn("_wait", wait).groupBy("host").agg(
        F.max_by("failures", order).alias("failures"), F.max(F.when(F.col("failed"), F.struct("at", "seq", "_wait"))).alias("f"), F.max("_now").alias("as_of")
    )
    until = F.timestamp_micros(F.unix_micros(F.col("f.at").cast("timestamp")) + F.col("f._wait") * 1_000_000)
    state = F.when(F.coalesce(until > F.col("as_of"), F.lit(False)), "blocked").when(F.col("failures") > 0, "recovering").otherwise("clean")
    return last.select("host", "failures", F.coalesce("f._wait", F.lit(0)).cast("long").alias("wait"), until.alias("until"), state.alias("state"), "as_of")


class _Host(StatefulProcessor):
    """One host's failures and deadline; a timer ends its block, and a second one forgets it when it has long been clean."""

    def __init__(self, forget_after: int):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType().add("failures", "integer").add("wait", "long").add("until", "timestamp").add("at", "timestamp"))

    def _row(self, host: str, failures: int, wait: int, until: dt.datetime | None, now: dt.datetime) -> pd.DataFrame:
        name = "blocked" if until is not None and until > now else "recovering" if failures else "clean"
        return pd.DataFrame({"host": [host], "failures": [failures], "wait": [wait], "until": [until], "state": [name], "as_of": [now]})

    @staticmethod
    def _ms(at: dt.datetime) -> int:
        return int(at.timestamp() * 1000) if at.tzinfo else int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000)

    def _timers(self, failures: int, until: dt.datetime | None, at: dt.datetime) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until is not None and until > at:
            self.handle.registerTimer(self._ms(until))
        elif not failures:
            self.handle.registerTimer(self._ms(at) + 1000 * self.forget_after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, wait, until, at = self.state.get() if self.state.exists() else (0, 0, None, None)
        for at, failed, retry_after in pd.concat(list(rows)).sort_values(["at", "seq"])[["at", "failed", "retry_after"]].itertuples(index=False):  # noqa: B007
            if failed:
                failures += 1
                wait = _wait(failures, retry_after)
                until = (at + pd.Timedelta(seconds=wait)).to_pydatetime()
            else:
                failures = 0
        at = pd.Timestamp(at).to_pydatetime()
        self.state.update((failures, wait, until, at))
        self._timers(failures, until, at)
        yield self._row(key[0], failures, wait, until, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, wait, until, at = self.state.get()
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").to_pydatetime()
        if until is not None and self._ms(until) == expiredTimerInfo.getExpiryTimeInMs():
            if not failures:
                self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 1000 * self.forget_after)
            yield self._row(key[0], failures, wait, until, now)
        else:
            self.state.clear()

    def close(self) -> None:
        return


def backoff_stream(attempts: DataFrame, late: str = "0 seconds", forget_after: int = 86_400) -> DataFrame:
    """Every change of a host's state: when its attempts come, and when event time passes its deadline; the last row of a host is its state.

    The attempts of a host must come in order from batch to batch; what is no newer than the
    watermark, ``late`` behind the newest attempt of the batches before, is left out.  A host that has been clean for ``forget_after`` seconds loses its state,
    which says the same as having none.
    """
    timed = attempts.withWatermark("at", late)
    return timed.groupBy("host").transformWithStateInPandas(_Host(forget_after), SCHEMA, "Update", "EventTime")
