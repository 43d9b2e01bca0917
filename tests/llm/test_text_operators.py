"""Operators on single texts against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import bytewords, pii_spans, quality_ledger, registry, spaced_seeds, url_lists

TABLES = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (2, ""), (None, "a b c"), (5, " \n\t"), (6, "x" * 200_000), (7, "one two three " * 40)]


def _odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("extra") for c in ("key", "row", "n_words", "spans", "t", "body", "w")})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(name, spark):
    duck = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = registry.queries()[name](spark, str(TABLES))
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\t.😀\x0b", max_size=60)), max_size=6))
def test_words_of_a_batch(texts):
    data, offsets = bytewords.raw_bytes(pa.array(texts, pa.string()))
    row, start, end, hashes = bytewords.words(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    got = [(int(r), bytes(data[a:b]).decode()) for r, a, b in zip(row, start, end, strict=True)]
    assert got == want
    assert len(set(hashes.tolist())) == len({w for _, w in want})


def test_hash_of_a_very_long_word():
    word = "ab" * 100_000
    data, offsets = bytewords.raw_bytes(pa.array([word + " x", word, word[:-1] + "c"]))
    _, _, _, h = bytewords.words(data, offsets)
    assert h[0] == h[2] != h[3]


def test_quality_ledger(spark):
    def brute(t):
        w = WORD.findall(t or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    random.seed(1)
    rows = [(i, " ".join(random.choice(["a", "b", "c\n", "é#", "d"]) for _ in range(random.randint(0, 60)))) for i in range(60)] + [(i, t) for i, t in ODD if t is None or len(t) < 1000]
    got = quality_ledger.quality_ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i or -1, *brute(t)) for i, t in rows)


def test_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean), (2, "few"), (3, clean + " ***" * 60), (4, "a b c " * 60)]
    df = _odd(spark).limit(0).select("doc_id", "text", "key").union(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")))
    assert [r.doc_id for r in quality_ledger.kept(df, "v2-all").collect()] == [1]
    ledger = quality_ledger.quality_ledger(df)
    table = {r.rule: (r.n_fail, r.n_fail_only, r.n_kept_without) for r in quality_ledger.ablation(ledger, "v2-all").collect()}
    assert table["few_words"] == (1, 1, 2)
    assert table["repeated_windows"][0] == 1  # of the third, 60 of 140 words repeat: under half
    assert quality_ledger.quality_ledger(_odd(spark)).count() == len(ODD)


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _pii(t):
    t = t or ""
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d)]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_pii(spark):
    random.seed(3)
    parts = ["a.b@c.de", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 555-1234", "x_y@z.org_q@r.st", " ", "é", "😀", "12", "-", ".", "GB82 WEST 1234 5698 7654 32", "+", "0001.2.3.4"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 14)))) for i in range(200)] + ODD
    got = pii_spans.digest(pii_spans.pii_spans(spark.createDataFrame(rows, SCHEMA))).collect()
    want = sorted((i or -1, hashlib.sha256(_pii(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or -1, r.base_sha256) for r in got) == want
    iban = pii_spans.digest(pii_spans.pii_spans(spark.createDataFrame([(1, "my IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32")], SCHEMA))).orderBy("doc_id").collect()
    assert [r.spans for r in iban] == ["iban:8:35", ""] and iban[0].scores == "1.00"


def test_many_spans_in_one_text(spark):
    text = " ".join("1.2.3.4" for _ in range(3000))
    r = pii_spans.digest(pii_spans.pii_spans(spark.createDataFrame([(1, text)], SCHEMA))).first()
    assert r.n_ip == 3000 and r.base_sha256 == hashlib.sha256(_pii(text).encode()).hexdigest()


def test_url_lists(spark):
    entries = spark.createDataFrame([("l", "domain", "bad.org", "add", "2024-01-02"), ("l", "domain", "bad.org", "remove", "2024-01-05"), ("l", "prefix", "ok.org/a/b", "add", "2024-01-01"), ("l", "domain", "tie.org", "add", "2024-01-01"), ("l", "domain", "tie.org", "remove", "2024-01-01"), (None, "domain", "ok.org", "add", "2024-01-01")], "list string, kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows = [(1, "http://x.bad.org/q", "2024-01-01"), (1, "http://x.bad.org/q", "2024-01-03"), (2, "http://x.bad.org/q", "2024-01-05"), (3, "https://ok.org/a/b/c", "2024-02-01"), (4, "https://ok.org/a/bc", "2024-02-01"), (5, None, "2024-02-01"), (6, "http://tie.org", "2024-02-01"), (7, "http://notbad.org/", "2024-01-03"), (8, "http://bad.org", None)]
    captures = spark.createDataFrame(rows, "id long, url string, at string").withColumn("at", F.col("at").cast("timestamp")).withColumn("list", F.lit("clash"))
    for bound in (100, 0):  # broadcast, and shuffled
        got = url_lists.temporal_list_join(captures, entries, "id", "url", "at", bound).collect()
        assert sorted((r.capture_id, r.matched) for r in got) == [(1, []), (1, ["l=bad.org"]), (2, []), (3, ["l=ok.org/a/b"]), (4, []), (5, []), (6, []), (7, []), (8, [])]
    assert url_lists.temporal_list_join(captures.limit(0), entries, "id", "url", "at").count() == 0
    assert url_lists.temporal_list_join(captures, entries.limit(0), "id", "url", "at").count() == len(rows)


def test_decontamination(spark):
    item = [f"token{i}" for i in range(30)]
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    rows = [(1, "lead in " + " ".join(item) + " tail"), (2, " ".join(changed)), (3, " ".join(item[5:20])), (4, " ".join(reversed(item))), (5, None), (6, ""), (1, "lead in " + " ".join(item) + " tail"), (7, " ".join(item[:8]))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, ""), (3, "two words")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in spaced_seeds.benchmark_hits(docs, bench).collect()) == [(1, 0), (1, 0), (2, 0), (3, 0)]
    assert sorted(r.doc_id for r in spaced_seeds.decontaminated(docs, bench).collect()) == [4, 5, 6, 7]
    assert spaced_seeds.benchmark_hits(docs.limit(0), bench).count() == spaced_seeds.benchmark_hits(docs, bench.limit(0)).count() == 0


def test_seeds_find_every_planted_item(spark):
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    tokens = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, tokens(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in tokens(r.text)}
    assert want <= {(r.doc_id, r.item_id) for r in spaced_seeds.benchmark_hits(docs, bench).collect()}
