"""Promotion as state: each group of claims keeps what it needs to become a fact, and no claim is read twice.

The state of a group (content and subject hash) holds its distinct claimants, the ids of its
claims, the newest of them and the sum of their confidences; once it has become a fact, only
that it has.  Facts come out once, in the micro-batch in which their quorum is met, and equal
what ``claims.promote`` makes of all claims so far beside the facts so far.  The sink's own
log ties them to their micro-batch: a batch that is run again writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.claims import DEFAULT_QUORUM, TRIPLE, content_hash, registry_entries, registry_keys, subject_hash

#: The state store that such state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _clamped(value: float) -> float:
    return float(np.float32(min(max(value, 0.0), 1.0))) if np.isfinite(value) else 0.0


class _Group(StatefulProcessor):
    """One group of claims on its way to a fact."""

    def __init__(self, least: int, id_type: T.DataType):
        self.least, self.id_type = least, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = lambda name, kind: T.StructType([T.StructField(name, kind)])
        summed = T.StructType().add("claims", "long").add("claimants", "long").add("total", "double").add("lowered", "integer").add("at", "timestamp").add("source", "string").add("id", self.id_type)
        self.done = handle.getValueState("done", one("done", T.BooleanType()))
        self.sums = handle.getValueState("sums", summed)
        self.claimants = handle.getMapState("claimants", one("claimant", T.StringType()), one("seen", T.BooleanType()))
        self.ids = handle.getListState("ids", one("id", self.id_type))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.done.update((True,))

    def _fact(self, key: tuple, row, claimants: int, support: list, source: str, by: str, confidence: float, representative) -> pd.DataFrame:
        fact = {"dedup_key": key[0]} | {c: getattr(row, c) for c in TRIPLE}
        fact |= {"n_claimants": claimants, "n_support": len(support), "representative": source, "representative_id": representative, "confidence": _clamped(confidence), "source_id": f"derived#{by}", "support": sorted(support)}
        self.done.update((True,))
        for state in (self.sums, self.claimants, self.ids):
            state.clear()
        return pd.DataFrame([fact])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        claims = pd.concat(list(rows))
        if self.done.exists():
            return
        # A claim has a row for itself and one for each entry that fits it.
        claims["at"] = list(zip(claims["observed_at"], claims["id"], strict=True))
        own = claims.drop_duplicates("row")
        alone = claims.groupby("row")["entry_alone"].max()
        lowered = claims.groupby("row")["entry_quorum"].min()
        passes = own["row"].map(alone).fillna(0).astype(bool)
        if passes.any():
            said = max(own[passes].itertuples(index=False), key=lambda r: r.at)
            yield self._fact(key, said, 1, [said.id], said.source_id, "authoritative", said.confidence, said.id)
            return
        n, claimants, total, least, at, source, newest = self.sums.get() if self.sums.exists() else (0, 0, 0.0, None, None, None, None)
        for who in own["claimant"].unique():
            if not self.claimants.containsKey((who,)):
                self.claimants.updateValue((who,), (True,))
                claimants += 1
        ids = own["id"].tolist()
        self.ids.appendList([(i,) for i in ids])
        last = max(own.itertuples(index=False), key=lambda r: r.at)
        if at is None or (last.observed_at, last.id) > (at, newest):
            at, source, newest = last.observed_at, last.source_id, last.id
        n, total = n + len(own), total + float(own["confidence"].sum())
        override = lowered.min()
        least = least if pd.isna(override) else int(override) if least is None else min(least, int(override))
        if claimants >= min(self.least, self.least if least is None else least):
            yield self._fact(key, last, claimants, [x[0] for x in self.ids.get()], source, "consensus", total / n, newest)
        else:
            self.sums.update((n, claimants, total, least, at, source, newest))

    def close(self) -> None:
        return


def promoting(claims: DataFrame, registry: DataFrame, topics: tuple[str, ...], promoted: DataFrame, least: int = DEFAULT_QUORUM) -> DataFrame:
    """The stream of new facts of a stream of claims; ``support`` has the ids of the claims that each rests on.

    promoted: dedup_key of facts from before the stream.  Write it in append mode.
    """
    own = claims if "topics" in claims.columns else claims.withColumn("topics", F.array(*[F.lit(t) for t in topics]).cast("array<string>"))
    own = own if "metric" in own.columns else own.withColumn("metric", F.col("kind"))
    key = F.concat_ws(":", F.lit("promotion"), content_hash(), subject_hash(F.col("topics"), F.array("rel_from", "rel_to")))
    keyed = own.select(key.alias("dedup_key"), *TRIPLE, "id", "claimant", "source_id", "observed_at", "confidence", "metric", "topics")
    # Claims are told apart within a micro-batch by all they say, repeats by a number.
    keyed = keyed.withColumn("row", F.expr("uuid()"))
    nothing = F.struct(F.lit(None).cast("string").alias("claimant"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("topic"))
    asked = keyed.withColumn("k", F.explode(F.array_append(registry_keys(F.col("claimant"), F.col("metric"), F.col("topics")), nothing)))
    hit = asked.alias("c").join(registry_entries(registry).alias("e"), F.expr("c.k.claimant = e.claimant AND c.k.metric <=> e.metric AND c.k.topic <=> e.topic"), "left")
    rows = hit.filter("k.claimant IS NULL OR entry_alone IS NOT NULL").select(*[F.col(f"c.{c}") for c in ("dedup_key", *TRIPLE, "id", "claimant", "source_id", "observed_at", "confidence", "row")], F.col("entry_alone").cast("int").alias("entry_alone"), "entry_quorum")
    id_type = claims.schema["id"].dataType
    out = T.StructType([T.StructField(c, T.StringType()) for c in ("dedup_key", *TRIPLE)])
    out = out.add("n_claimants", "long").add("n_support", "long").add("representative", "string").add("representative_id", id_type).add("confidence", "float").add("source_id", "string").add("support", T.ArrayType(id_type))
    known = promoted.select("dedup_key").distinct().groupBy("dedup_key")
    return rows.groupBy("dedup_key").transformWithStateInPandas(_Group(least, id_type), out, "Append", "None", initialState=known)
