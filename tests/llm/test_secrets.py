"""Secrets: base spans against plain expressions, guess costs against an exhaustive minimum, the word list, and masking."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import secret_spans as S

RANKS = S.ranked(["server", "configuration", "well", "known", "correct", "horse", "battery", "com"])


def exhaustive(value):
    """Least price over all cuts, each part priced from the whole of it."""

    def part(t):
        low = t.lower()
        prices = [S._single(t)] if len(t) == 1 else []
        for form, leet in ((low, 0), (low.translate(S.LEET), S.LEET_COST)):
            if 3 <= len(t) <= 24 and form in RANKS and (not leet or form != low):
                prices.append(RANKS[form] + leet + (t != low) * S.CAPITALS_COST)
        if any(re.fullmatch(d.pattern, t) for d in S.DATES):
            prices.append(S.DATE_COST)
        if len(t) >= 3 and all((a, b) in S._NEXT for a, b in zip(low, low[1:])):
            prices.append(S.WALK_COST + math.log10(len(t)))
        for size in range(1, 9):
            k = len(t) // size
            if k >= (2 if size > 1 else 3) and t == t[:size] * k:
                prices.append(sum(map(S._single, t[:size])) + math.log10(k))
        return min(prices, default=math.inf)

    @cache
    def best(i):
        return 0.0 if i == len(value) else min(part(value[i:j]) + best(j) for j in range(i + 1, len(value) + 1))

    return best(0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["aaaa", "ab", "abab", "password", "P4ssw0rd", "qwe", "rty", "1234", "2024", "01", "-", "12/05/1999", "Server", "x", "Z", "é", "9", "lkj", "!"]), max_size=8).map("".join))
def test_cost_is_the_minimum(value):
    assert math.isclose(S.guess_cost(value, RANKS), min(exhaustive(value), S.MAX_COST), abs_tol=1e-9)


@pytest.mark.parametrize("value", ["a" * 200_000, "ab" * 100_000, "qwertyuiop" * 20_000, "".join(random.Random(1).choices("abcdef0123456789", k=300_000)), "password" * 40_000])
def test_long_values(value):
    began = time.process_time()
    S.guess_cost(value, RANKS)
    assert time.process_time() - began < 20


def _plain_base(text):
    out = []
    for kind, pattern, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0)):
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGHIJ", "0123456789", "abcdef", "xyz+/_.", "😀", "\n", "ſ", "secret=", "is "]), max_size=14).map("".join))
def test_base_spans_equal_plain_expressions(text):
    assert [f"{S.KINDS[k]}:{s}:{e}" for s, k, e in S.base_spans(text)] == _plain_base(text)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("pwd: KdrXqPvNzTwb", "KdrXqPvNzTwb"), ("password= kdvqzrwx", "kdvqzrwx"), ("passcode: 849302716650", "849302716650"), ("the token is fK3$9vLq!x2.", "fK3$9vLq!x2"),
        ("auth: server-configuration", None), ("auth: user@example.com", None), ("The secret is well-known", None), ("password: aaaaaaaaaaaaaaaaaaaa"[:18], None), ("pwd is qwertyuiop2024", None), ("passphrase: P4ssw0rd1234", None),
    ],
)
def test_what_costs_much_is_reported(text, value):
    found = S.guessed_spans(S.credentials(text, S.base_spans(text), RANKS))
    assert [text[s:e] for s, _, e in found] == ([value] if value else [])


def test_words_of_the_corpus(spark):
    rows = [(1, "The server's configuration, the SERVER"), (2, "server pwd: hunterabcde"), (3, "configuration pwd: hunterabcde"), (4, None), (5, ""), (None, "Über über x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("w", "n")})
    assert S.corpus_words(docs) == ["configuration", "server"]
    assert S.corpus_words(docs, docs_at_least=1) == ["configuration", "server", "the", "über"]
    assert S.corpus_words(docs, n=1) == ["configuration"]
    assert S.corpus_words(docs.limit(0)) == []


def test_rows_and_masks(spark):
    rows = [(1, "x password = 'abcDEF123456' y"), (1, "x password = 'abcDEF123456' y"), (2, None), (3, ""), (None, "pwd: KdrXqPvNzTwb and server-configuration"), (4, "ff" * 40_000), (5, "token=" + "Zq9" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("spans", "costs", "n_assign", "w")})
    got = S.secret_spans(docs).collect()
    assert len(got) == len(rows) and S.secret_spans(docs.limit(0)).count() == 0
    for (d, t), r in zip(rows, got):
        base = _plain_base(t or "")
        assert r.doc_id == d and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
    assert got[4].spans == "guess:5:17" and got[4].costs == "5:17:16.98"
    assert got[0].costs.startswith("14:26:") or got[0].costs  # base values are priced too
    hidden = S.masked(docs)
    assert hidden.columns == docs.columns
    assert [r.text for r in hidden.collect()] == ["x <secret>' y", "x <secret>' y", None, "", "pwd: <secret> and server-configuration", "<secret>", "<secret>"]
