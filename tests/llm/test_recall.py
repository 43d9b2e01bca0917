"""How much is found, kind by kind: planted personal data and credentials among prose, and what clean prose is reported."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pii_spans, secret_spans

PROSE = "the river of that town had many boats and some of them were red while others were blue and the people who lived there went to the market each day to buy bread and fish for the evening meal with their friends".split()


def _luhn(rng, n):
    digits = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(n - 2)]
    total = sum(d if (n - 1 - i) % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def _iban(rng):
    country, account = rng.choice(["DE", "FR", "GB"]), "".join(rng.choices(string.digits, k=18))
    rest = int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    return f"{country}{98 - rest:02}{account}"


def _grouped(rng, number, marks):
    return rng.choice(marks).join(number[i : i + 4] for i in range(0, len(number), 4))


PERSONAL = {
    "email": lambda rng: f"{rng.choice(['a.b', 'x+y', 'n_1', 'Q%q'])}{rng.randint(1, 99)}@{rng.choice(['mail', 'ex-1'])}.{rng.choice(['org', 'co.uk'])}",
    "ip": lambda rng: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    "card": lambda rng: _grouped(rng, _luhn(rng, rng.randint(14, 19)), ["", " ", "-"]),
    "phone": lambda rng: rng.choice(["+{} {} {}", "+{} ({}) {}", "+{}.{}.{}", "+{}-{}-{}"]).format(rng.randint(1, 99), rng.randint(100, 999), rng.randint(100_000, 9_999_999)),
    "iban": lambda rng: _grouped(rng, _iban(rng), ["", " "]),
}


def _among(rng, what):
    before, after = rng.choices(PROSE, k=rng.randint(0, 30)), rng.choices(PROSE, k=rng.randint(0, 30))
    return " ".join([*before, what, *after])


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    return [(kind, v := make(rng), _among(rng, v)) for kind, make in PERSONAL.items() for _ in range(60)] + [("none", "", _among(rng, "said")) for _ in range(200)]


def test_personal_data_by_kind(spark, planted):
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(planted)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii_spans.pii_spans(docs).collect()}
    recall = {}
    for i, (kind, value, text) in enumerate(planted):
        if kind == "none":
            assert found[i] == []
        else:
            at = text.index(value)
            recall.setdefault(kind, []).append(any(s["kind"] == kind and s["start"] == at and s["end"] == at + len(value) for s in found[i]))
    assert {k: sum(v) / len(v) for k, v in recall.items()} == dict.fromkeys(PERSONAL, 1.0)


CONTEXTS = ("password: {}", "my passphrase is {}", "pwd={}", 'client_secret = "{}"', "auth: {}", "api-key: {}", "bearer is {}", "the credentials: {}")
CHARACTERS = string.ascii_letters + string.digits + "!#$%&*?@^~"


def test_credentials_in_free_text(spark):
    """Random values of 10 and more characters in a context are found; prose, dates and walks in the same places are not."""
    rng = random.Random(22)
    strong = [(c, "".join(rng.choices(CHARACTERS, k=rng.randint(10, 30)))) for c in CONTEXTS for _ in range(30)]
    weak = [(c, w) for c in CONTEXTS for w in ("password", "qwertyuiop", "aaaaaaaaaaaa", "1999-12-31", "friendsmarket", "evening-meal", "abcdefgh", "12345678")]
    texts = [_among(rng, c.format(v)) for c, v in strong + weak] + [" ".join(rng.choices(PROSE, k=80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secret_spans.secret_spans(docs).select("doc_id", F.col("spans")).collect()}
    hit = lambda i: "guess:" in out[i] or "assign:" in out[i] or "hex:" in out[i]
    by_context = {c: sum(hit(i) for i, (x, _) in enumerate(strong) if x == c) / 30 for c in CONTEXTS}
    assert min(by_context.values()) >= 0.9, by_context
    told = [w for i, (_, w) in enumerate(weak, len(strong)) if "guess:" in out[i]]
    assert not told, told
    assert not any(out[i] for i in range(len(strong) + len(weak), len(texts)))
