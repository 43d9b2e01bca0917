"""Comparison inside groups of rows that share a value, in tiles of bounded size.

A group with more rows than a tile holds is cut into blocks by hash; every pair of blocks is a
tile, and tiles are dealt over tasks by their number, whatever their group.  In a tile rows stand in the
order of one column, and a row is compared with those that follow it up to a bound on that
column: the blocks beyond are skipped without being looked at.  Only pairs of different labels that
pass the caller's test leave a tile, of each key no more from a task than the caller says.

Groups of few rows need no tiles: ``settled`` compares them where their rows meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import giving_back, materialise
from .sketches import Wide

#: Rows of a group's block, rows of tiles that one task reads at a time, about, and pairs tested at a time.
TILE, TASK_ROWS, STEP = 4096, 50_000, 1 << 18
#: Large groups that are broadcast: 24 bytes each.
BROADCAST_GROUPS = 200_000
#: Groups up to this size are compared all at once, by the distance of their rows.
SMALL = 64
#: Pairs for each row that a small group may give at once.
FEW = 4

Columns = dict[str, np.ndarray]


def _tiles(rows: DataFrame, group: list[str], tile: int) -> DataFrame:
    """Rows with the number of their tile and their side in it: 2 in a tile of one block with itself, else 0 or 1."""
    # Groups beyond a tile: one row for that many rows at least, broadcast while they are few.
    large = materialise(rows.groupBy(*group).agg(F.count("*").alias("many")).filter(F.col("many") > tile))
    held = rows.join(F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large, group, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("many") / tile), F.lit(1)).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"), F.when(o == F.col("block"), 2).when(o < F.col("block"), 1).otherwise(0).cast("byte").alias("side"))
    held = held.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), other)))
    return held.withColumns({"tile": F.xxhash64(*group, "t.i", "t.j"), "side": F.col("t.side")}).drop(*group, "many", "blocks", "block", "t")


def _matched(columns: Columns, order: np.ndarray, until: np.ndarray, test: Callable[[Columns, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of one tile and of different labels that pass the test; ``order`` is what rows are sorted by within their tile, ``until`` up to where a row looks."""
    tile, label, side = columns["tile"], columns["label"], columns["side"]
    n = len(tile)
    end = np.searchsorted(tile, tile, side="right")
    size = end - np.searchsorted(tile, tile, side="left")
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(x: np.ndarray, y: np.ndarray) -> None:
        fits = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2)) & (order[y] <= until[x])
        x, y = x[fits], y[fits]
        for lo in range(0, len(x), STEP):
            a, b = x[lo : lo + STEP], y[lo : lo + STEP]
            good = test(columns, a, b)
            xs.append(a[good])
            ys.append(b[good])

    x = np.flatnonzero((size > 1) & (size <= SMALL))
    for d in range(1, SMALL):
        x = x[x + d < end[x]]
        if not len(x):
            break
        take(x, x + d)
    for lo in np.flatnonzero((size > SMALL) & (np.append(True, tile[1:] != tile[:-1])[:n])).tolist():
        hi = int(end[lo])
        if (label[lo:hi] == label[lo]).all():
            continue
        for at in range(lo, hi, SMALL):
            stop = min(at + SMALL, hi)
            # Rows are in order: blocks beyond the furthest bound are skipped.
            top = lo + int(np.searchsorted(order[lo:hi], until[at:stop].max(), side="right"))
            i, j = np.meshgrid(np.arange(at, stop), np.arange(at, top), indexing="ij")
            later = j > i
            take(i[later], j[later])
    return np.concatenate(xs), np.concatenate(ys)


def _thinned(x: np.ndarray, y: np.ndarray, mark: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, no more than most of a lesser key; a key that has more is given as x and y, with mark 0."""
    order = np.lexsort((-mark, y, x))
    x, y, mark = x[order], y[order], mark[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    x, y, mark = x[new], y[new], mark[new]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    more = x[rank == most]
    kept = rank < most
    return np.concatenate([x[kept], more]), np.concatenate([y[kept], more]), np.concatenate([mark[kept], np.zeros(len(more), mark.dtype)])


def settled(rows: DataFrame, group: str, by: str, until: Callable[[Columns], np.ndarray], test: Callable[[Columns, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs of rows that pass the test, as x, y (the lesser key first), of groups with SMALL rows at most; each row is sent once.

    A group with more than FEW such pairs for each row gives none of them: its rows come back as they are, with x and y null.  The arguments are those of ``compared``.
    """
    tasks = max(rows.count() // TASK_ROWS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("x", LongType()), StructField("y", LongType())])

    @giving_back
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(group, "ascending"), (by, "ascending")]).select(names)
        columns = {c: table.column(c).to_numpy() for c in names}
        key = columns["key"]
        x, y = _matched(columns | {"tile": columns[group], "label": key, "side": np.full(len(key), 2)}, columns[by], until(columns), lambda c, a, b: test(c, a, b) > 0)
        _, number, many = np.unique(columns[group], return_inverse=True, return_counts=True)
        dense = np.bincount(number[x], minlength=len(many)) > FEW * many
        sparse = ~dense[number[x]]
        back = table.filter(pa.array(dense[number]))
        a, b = key[x[sparse]], key[y[sparse]]
        blank = {c: pa.nulls(len(a), table.schema.field(c).type) for c in names}
        none = pa.nulls(len(back), pa.int64())
        return pa.concat_tables([back.append_column("x", none).append_column("y", none), pa.table(blank | {"x": np.minimum(a, b), "y": np.maximum(a, b)})])

    return rows.withColumn("task", F.pmod(F.xxhash64(group), F.lit(tasks))).groupBy("task").applyInArrow(compare, schema)


def compared(
    rows: DataFrame, group: list[str], by: str, until: Callable[[Columns], np.ndarray], test: Callable[[Columns, np.ndarray, np.ndarray], np.ndarray], tile: int = TILE, parities: DataFrame | None = None, most: int | None = None
) -> DataFrame:
    """x, y (the lesser key first) and what the test says of the pairs that it lets through: 1, or 2 where the pair is known to be a link.

    rows is a stored table, or made of one without a shuffle: it is read several times.  It has the columns of group, key, label, and what the test reads (numbers, or binaries of words of 64 bits); rows
    stand in the order of ``by``, and the test takes the columns and places x, y (x before y) and gives 0, 1 or 2.

    parities (key, parity) come to each task once for each of its keys, however many rows that has there: the test finds them as
    ``wide``, and a row's place in them as ``at``.  With ``most``, a task gives no more than so many pairs of a lesser key; keys that
    have more come as x and y with the answer 0.
    """
    held = _tiles(rows, group, tile)
    tasks = max(rows.count() // TASK_ROWS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def found(table: pa.Table, beside: pa.Table | None) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), (by, "ascending")])
        columns = {}
        for name in table.column_names:
            c = table.column(name)
            columns[name] = np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy()
        if beside is not None:
            beside = beside.sort_by("of")
            columns["wide"] = Wide(beside.column("parity").to_pylist())
            columns["at"] = np.searchsorted(beside.column("of").to_numpy(), columns["key"])
        said: list[np.ndarray] = []

        def kept(cols: Columns, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            mark = test(cols, x, y)
            said.append(mark[mark > 0])
            return mark > 0

        x, y = _matched(columns, columns[by], until(columns), kept)
        mark = np.concatenate(said) if said else np.zeros(0, np.int64)
        key = columns["key"]
        pairs = np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), mark.astype(np.int32)
        return pa.table(dict(zip("x y mark".split(), pairs if most is None else _thinned(*pairs, most), strict=True)))

    @giving_back
    def compare(table: pa.Table) -> pa.Table:
        return found(table, None)

    @giving_back
    def compare_beside(table: pa.Table, beside: pa.Table) -> pa.Table:
        return found(table, beside)

    held = held.withColumn("task", F.pmod(F.col("tile"), F.lit(tasks)))
    if parities is None:
        made = held.groupBy("task").applyInArrow(compare, "x long, y long, mark int")
    else:
        sent = held.select(F.col("task").alias("to"), F.col("key").alias("of")).distinct().join(parities.withColumnRenamed("key", "of"), "of")
        made = held.groupBy("task").cogroup(sent.groupBy("to")).applyInArrow(compare_beside, "x long, y long, mark int")
    return made.groupBy("x", "y").agg(F.max("mark").alias("mark"))
