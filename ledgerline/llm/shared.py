"""What several operators need: cutting lineage through the shared checkpoint folder, and giving memory back."""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir, so that a lost executor loses nothing.

    Where the session names no folder, a session on one machine (a test) uses its temporary folder; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    done = df.checkpoint(eager=True)
    # Shuffle files of the lineage that was cut go when the driver collects its garbage; that may be long after.
    gc.collect()
    context._jvm.System.gc()
    return done


#: Bytes of text whose records meet in one group, about.
GROUP_BYTES = 64 << 20


def group_count(df: DataFrame, column: str, least: int) -> int:
    """Into how many groups the records of a column's bytes are dealt: so that none grows with the corpus, and no fewer than least."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, total // GROUP_BYTES)


def _give_back() -> None:
    """Freed memory that Arrow's pool and the C library still hold goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def giving_back(f: Callable) -> Callable:
    """f over batches, over one group or over two that belong together; when it is done, its worker, which waits for further tasks, keeps no freed memory."""
    if inspect.isgeneratorfunction(f):

        def batches(it):
            yield from f(it)
            _give_back()

        return batches

    def group(table):
        out = f(table)
        _give_back()
        return out

    def two_groups(table, beside):
        out = f(table, beside)
        _give_back()
        return out

    return two_groups if len(inspect.signature(f).parameters) == 2 else group
