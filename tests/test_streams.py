"""Streams against their batch forms: promotion, host back-off with timers, sliding sums with late rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import claims as C
from ledgerline.streaming.backoff import backoff_stream, host_backoff
from ledgerline.streaming.promotion import STORE, promoting
from ledgerline.streaming.recent import in_time, sliding_sums

CLAIM = "id long, claimant string, kind string, rel_from string, rel_to string, source_id string, confidence double, observed_at timestamp"
REGISTRY = [("agency:9", None, "lithium", 1), ("7", "owns", None, None), ("agency:8", "sells", None, 2), ("agency:6", None, "copper", 1)]


@pytest.fixture(autouse=True)
def _store(spark):
    spark.conf.set(*STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(STORE[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _run(stream, folder, mode):
    """One micro-batch for each file that is there; rows with the number of their batch."""
    seen = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def _claims(rng, n):
    at = dt.datetime(2026, 1, 1)
    return [(i, f"agency:{rng.choice([1, 1, 2, 3, 4, 6, 7, 8, 9])}", rng.choice(["owns", "sells"]), "company:1", f"mine:{rng.randint(1, 9)}", f"s{i}", round(rng.uniform(-0.5, 1.5), 3), at + dt.timedelta(minutes=rng.randint(0, 500))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_promotion_equals_the_batch_however_claims_are_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = _claims(rng, 70)
    registry = spark.createDataFrame(REGISTRY, "claimant string, metric string, topic string, quorum int")
    first = C.promote(spark.createDataFrame(rows[:20], CLAIM), registry, spark.createDataFrame([], "dedup_key string"), ("lithium",)).select("dedup_key").limit(2)
    known = spark.createDataFrame([tuple(r) for r in first.collect()], "dedup_key string")
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    facts, so_far, want = known, [], []
    columns = ["dedup_key", *C.TRIPLE, "n_claimants", "n_support", "representative", "representative_id", "confidence", "source_id"]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, CLAIM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        so_far += batch
        judged = C.judged(spark.createDataFrame(so_far, CLAIM), registry, ("lithium",))
        new = C.promoted_groups(judged).join(facts.select("dedup_key"), "dedup_key", "left_anti")
        found = [tuple(r) for r in new.select(*columns).collect()]
        edges = {}
        for r in C.support_edges(new, judged).collect():
            edges.setdefault(r["child_id"], []).append(r["parent_id"])
        want += [(n, *r, sorted(edges[r[0]])) for r in found]
        facts = facts.union(spark.createDataFrame([(r[0],) for r in found], "dedup_key string"))
        # The stream reads only what is new: each run adds the batch of one file.
    files = spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = _run(promoting(files, registry, ("lithium",), known), str(tmp_path), "append")
    near = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(near((n, *[r[c] for c in columns], r["support"])) for n, r in seen) == sorted(map(near, want))
    assert {w[9] for w in want} | {w[-2] for w in want} >= {"derived#authoritative", "derived#consensus"}


def test_a_restarted_stream_makes_no_fact_twice(spark, tmp_path):
    registry = spark.createDataFrame([], "claimant string, topic string, quorum int")
    none = spark.createDataFrame([], "dedup_key string")
    claim = lambda who, i: (i, f"agency:{who}", "owns", "company:1", "mine:1", f"s{i}", 0.5, dt.datetime(2026, 1, 1, 0, i))
    counts = []
    for who, i in (("a", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 5)):
        spark.createDataFrame([claim(who, i)], CLAIM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        facts = promoting(spark.readStream.schema(CLAIM).parquet(str(tmp_path / "in")), registry, ("lithium",), none)
        facts.writeStream.format("parquet").option("path", str(tmp_path / "facts")).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "facts")).count())
    assert counts == [0, 0, 1, 1, 1]
    assert spark.read.parquet(str(tmp_path / "facts")).first()["support"] == [1, 2, 3]


ATTEMPT = "host string, at timestamp, failed boolean, retry_after double, seq long"


def test_backoff_equals_a_snapshot_after_each_batch(spark, tmp_path):
    rng = random.Random(6)
    start, t, rows, changes = dt.datetime(2026, 1, 1), 0, [], []
    for _ in range(5):
        batch = []
        t += 1
        for _ in range(8):
            t += rng.randint(0, 12)
            batch.append((f"h{rng.randint(1, 4)}", start + dt.timedelta(seconds=t), rng.random() < 0.7, float(rng.randint(5, 90)) if rng.random() < 0.2 else None, len(rows) + len(batch)))
        rows += batch
        spark.createDataFrame(batch, ATTEMPT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = backoff_stream(spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "in")))
        changes += [r for _, r in _run(stream, str(tmp_path), "update")]
        now = max(r[1] for r in rows)
        last = {r["host"]: r for r in changes}
        want = {r["host"]: r for r in host_backoff(spark.createDataFrame(rows, ATTEMPT), F.lit(now)).collect()}
        assert {h: (r["failures"], r["wait"], r["until"], r["state"]) for h, r in last.items()} == {h: (r["failures"], r["wait"], r["until"], r["state"]) for h, r in want.items()}
    assert {"blocked", "recovering"} <= {r["state"] for r in changes}


def test_a_clean_host_is_forgotten(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    files = [[("a", at(0), True, None, 1), ("a", at(1), False, None, 2)], [("b", at(500), False, None, 3)], [("a", at(501), True, None, 4)]]
    out = []
    for f in files:
        spark.createDataFrame(f, ATTEMPT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.append([(r["host"], r["failures"], r["state"]) for _, r in _run(backoff_stream(spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "in")), forget_after=100), str(tmp_path), "update")])
    assert out == [[("a", 0, "clean")], [("b", 0, "clean")], [("a", 1, "blocked")]]


def test_snapshots_at_an_instant(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(0), True, None, 1), ("a", at(3), True, None, 2), ("b", at(1), True, 30.0, 3), ("b", at(2), False, None, 4), ("c", at(9), False, None, 5)], ATTEMPT)
    state = lambda s: {r["host"]: (r["failures"], r["wait"], r["state"]) for r in host_backoff(df, F.lit(at(s))).collect()}
    assert state(0) == {"a": (1, 1, "blocked")} and state(1) == {"a": (1, 1, "recovering"), "b": (1, 30, "blocked")}
    assert state(4) == {"a": (2, 2, "blocked"), "b": (0, 30, "blocked")} and state(31) == {"a": (2, 2, "recovering"), "b": (0, 30, "clean"), "c": (0, 0, "clean")}


def test_sliding_sums_leave_late_rows_out_by_rule(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    rows, schema = [], "at timestamp, key string, value long, batch int"
    for n in range(5):
        base = n * 60
        batch = [(start + dt.timedelta(seconds=max(0, base + rng.randint(-250, 60))), rng.choice("ab"), rng.randint(1, 9), n) for _ in range(25)]
        rows += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sliding_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "at", "key", "value", "60 seconds", "20 seconds", late="30 seconds")
    seen = [r for _, r in _run(stream, str(tmp_path), "append")]
    kept = in_time(spark.createDataFrame(rows, schema), "at", "batch", F.expr("INTERVAL 30 SECONDS"))
    windows = kept.select("*", F.window("at", "60 seconds", "20 seconds").alias("w")).filter("closed IS NULL OR w.end > closed")
    newest = max(r[0] for r in rows) - dt.timedelta(seconds=30)
    want = windows.groupBy("w", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).filter(F.col("w.end") <= F.lit(newest))
    assert sorted((r["from"], r["key"], r["n"], r["total"]) for r in seen) == sorted((r["w"]["start"], r["key"], r["n"], r["total"]) for r in want.collect())
    assert kept.count() == len(rows) and len(seen) > 10
    lost = kept.withColumn("ends", F.window("at", "60 seconds", "20 seconds").alias("w")).filter("ends.end <= closed").count()
    assert lost > 0
