"""Kneser-Ney models against a plain implementation by dictionaries, and language identification."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.llm import kneser_ney as K

SCHEMA = "doc_id long, text string, lang string"


def _sentence(rng, letters, n):
    return " ".join("".join(rng.choices(letters, weights=range(len(letters), 0, -1), k=rng.randint(1, 6))) for _ in range(n))


def _rows(seed, sizes):
    rng = random.Random(seed)
    alphabets = {"aa": "etaoinsr", "bb": "aeioulmn", "cc": "xzkwvqjy"}
    return [(i, _sentence(rng, alphabets[lang], 12), lang) for lang, n in sizes.items() for i in range(n)]


def _plain(texts, all_letters):
    """Probability of a character after three others: interpolated Kneser-Ney by dictionaries of strings."""
    top = Counter()
    for t in texts:
        t = "   " + " ".join(("".join(c if c.isalpha() else " " for c in t.lower())).split(" "))
        while "  " in t[3:]:
            t = t[:3] + t[3:].replace("  ", " ")
        for i in range(3, len(t)):
            top[t[i - 3 : i + 1]] += 1
    counts = {4: top}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    after = {k: defaultdict(dict) for k in counts}
    discount = {}
    for k, c in counts.items():
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[k] = one / (one + 2 * two) if one and two else 0.5
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    def p(k, context, char):
        if k == 0:
            return 1 / (all_letters + 1)
        seen = after[k].get(context)
        lower = p(k - 1, context[1:], char)
        if not seen:
            return lower
        total, d = sum(seen.values()), discount[k]
        return max(seen.get(char, 0) - d, 0) / total + d * len(seen) / total * lower

    return p


def test_probabilities_equal_a_plain_implementation(spark):
    rows = _rows(1, {"aa": 40, "bb": 30})
    model = K.fit(spark.createDataFrame(rows, SCHEMA))
    letters = len({c for _, t, _ in rows for c in t.lower()})
    rng = random.Random(2)
    for j, lang in enumerate(model.langs):
        p = _plain([t for _, t, x in rows if x == lang], letters)
        for _ in range(300):
            gram = rng.choice([t for _, t, _ in rows])[:4].lower() if rng.random() < 0.5 else "".join(rng.choices("etaoinlmu q", k=4))
            if len(gram) < 4:
                continue
            key = sum(ord(c) << 16 * i for i, c in enumerate(reversed(gram)))
            got = model.log_p(np.array([key], np.uint64), 4)[0, j]
            assert math.isclose(got, math.log(p(4, gram[:3], gram[3])), abs_tol=1e-4), (lang, gram)


def test_pruned_models_still_add_up_to_one(spark):
    rows = _rows(3, {"aa": 80, "bb": 80})
    for most in (10**7, 200):
        model = K.fit(spark.createDataFrame(rows, SCHEMA), max_windows=most)
        letters = np.unique(np.concatenate([model.levels[0][0]]))
        for context in ("tea", "a e", "lun"):
            base = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
            p = np.exp(model.log_p(np.uint64(base) + letters, 4).astype(float)).sum(axis=0)
            assert (p < 1.001).all() and (p > 0.9).all()  # the rest is for letters never seen
    assert len(model.levels[3][0]) < 300


def test_rare_language_beside_large_ones(spark):
    """Under a small bound a language with little text keeps its windows and its label."""
    rows = _rows(4, {"aa": 400, "bb": 400, "cc": 12})
    fitted = K.fit(spark.createDataFrame(rows, SCHEMA), max_windows=1_000)
    assert fitted.langs == ["aa", "bb", "cc"]
    e, _, _ = fitted.entropies(pa.array([t for _, t, x in _rows(5, {"cc": 20})]))
    assert (e.argmin(axis=1) == 2).all()


def test_listed_arrays_give_the_same_probabilities(spark):
    fitted = {}
    rows = _rows(8, {"aa": 60, "bb": 50, "cc": 9})
    for cells in (10**9, 0):
        fitted[cells] = K.fit(spark.createDataFrame(rows, SCHEMA), max_windows=1_500, dense_cells=cells)
    dense, listed = fitted[10**9], fitted[0]
    assert dense.dense and not listed.dense
    column = pa.array([t for _, t, _ in rows] + ["xzkw etao", "", None, "зж q"])
    keys, _, _ = K.windows(column)
    for k in range(1, K.ORDER + 1):
        part = keys & np.uint64((1 << 16 * k) - 1)
        assert np.allclose(dense.log_p(part, k), listed.log_p(part, k), atol=1e-4)


def test_a_hundred_languages(spark):
    """Languages of one alphabet that differ in their syllables: the share of each falls with their number, not with its square."""
    rng = random.Random(12)
    syllables = {f"l{j:03}": [rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "n", "s", "r"]) for _ in range(25)] for j in range(100)}
    text = lambda name, n: " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(100 * i + j, text(name, 25), name) for j, name in enumerate(syllables) for i in range(24)]
    got = {}
    for most in (K.MAX_WINDOWS, 40_000):
        found = K.identify(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 400 < 300, max_windows=most).select("doc_id", "lang_pred", "rejected").collect()
        held = [r for r in found if r["doc_id"] % 400 >= 300]
        got[most] = sum(r["lang_pred"] == f"l{r['doc_id'] % 100:03}" for r in held) / len(held)
    assert got[K.MAX_WINDOWS] > 0.99 and got[40_000] > 0.97


def test_few_texts_reject_few():
    rng = np.random.default_rng(3)
    for n in (5, 15, 75):
        beyond = [float((rng.gamma(40, 0.05, 4000) > K._exceeded_by_few(rng.gamma(40, 0.05, n))).mean()) for _ in range(200)]
        assert np.mean(beyond) < (0.04 if n < 75 else 0.002)


def test_held_out_accuracy_and_rejection(spark):
    rows = _rows(6, {"aa": 600, "bb": 600})
    rows = [(i, t, x) for i, (_, t, x) in enumerate(rows)]
    odd = [(5000, None, "aa"), (5001, "", None), (5002, "12 34 !?", "bb"), (None, "tea eat tone", None), (7, rows[7][1], "aa"), (5003, "зжщ ыъэ " * 20, None), (5004, "etaoin " * 40_000, None), (5005, "tea 𝔘 ſ", None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("t", "h", "n", "k", "key", "score", "hash")})
    got = [r.asDict() for r in K.identify(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))).collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    held = [(by_id[i]["lang_pred"] == x, by_id[i]["rejected"]) for i, _, x in rows if i % 3 == 0]
    assert sum(ok for ok, _ in held) / len(held) > 0.99 and sum(r for _, r in held) / len(held) < 0.05
    assert by_id[5003]["rejected"]  # a script never seen
    assert [by_id[i]["lang_pred"] for i in (5000, 5001, 5002)] == ["und"] * 3 and by_id[5000]["score"] == 0
    assert by_id[None]["lang_pred"] == "aa" and by_id[5004]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in K.identify(docs.repartition(7), F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))).collect())
    assert K.identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in K.identify(docs, F.lit(False)).collect()} == {"und"}
