"""Large groups of near copies: what leaves the tiles of op8's join, and that no link is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import set_join, sketches, tiles


def _edited(rng: random.Random, passage: list[str], changes: int) -> list[str]:
    words = list(passage)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def _expected(rows: list[tuple[int, str]], percent: int, k: int) -> list[tuple]:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and root(x) != root(y):
                least[max(root(x), root(y))] = min(root(x), root(y))
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def _run(spark, monkeypatch, rows: list[tuple[int, str]], percent: int, k: int) -> tuple[list[tuple], list[dict[int, int]]]:
    whole, left = set_join.compared, []

    def counted(*a):
        out = tiles.materialise(whole(*a))
        left.append({r["mark"]: r["count"] for r in out.groupBy("mark").count().collect()})
        return out

    monkeypatch.setattr(set_join, "compared", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in set_join.near_duplicates(docs, percent=percent, k=k).select("doc", "n_shingles", "component").collect()), left


def test_near_copies_below_the_threshold_stay_in_their_tiles(spark, monkeypatch):
    """400 texts of 400 words that differ from each other in about 141 shingles of 400, beyond the 88 of a link: 256 bits are full and let pairs go, wider parities do not."""
    rng = random.Random(1)
    passage = [f"p{j}" for j in range(400)]
    rows = [(i, " ".join(_edited(rng, passage, 15))) for i in range(400)]
    rows.append((400, rows[7][1] + " and more"))
    got, left = _run(spark, monkeypatch, rows, 80, 5)
    assert got == _expected(rows, 80, 5)
    assert sum(n for marks in left for n in marks.values()) < 400


@pytest.mark.parametrize("most", [1, 3])
def test_many_links_of_one_set_are_found_in_rounds(spark, monkeypatch, most):
    """Near copies about the threshold: some pairs are linked, some not.  However few pairs of a set a task gives, the components are those of all links."""
    monkeypatch.setattr(set_join, "MOST", most)
    monkeypatch.setattr(set_join, "MORE", 2)
    rng = random.Random(2)
    rows = []
    for group in range(3):
        passage = [f"g{group}_{j}" for j in range(120)]
        rows += [(200 * group + i, " ".join(_edited(rng, passage, rng.choice((1, 2, 3, 4))))) for i in range(120)]
    got, left = _run(spark, monkeypatch, rows, 80, 5)
    assert got == _expected(rows, 80, 5)
    assert len(left) > 1


def test_thinning_says_which_keys_have_more():
    x, y, mark = tiles._thinned(np.array([1, 1, 1, 1, 2]), np.array([5, 4, 4, 6, 9]), np.array([1, 1, 2, 1, 1]), 2)
    assert sorted(zip(x.tolist(), y.tolist(), mark.tolist(), strict=True)) == [(1, 1, 0), (1, 4, 2), (1, 5, 1), (2, 9, 1)]
    assert [len(c) for c in tiles._thinned(*[np.zeros(0, np.int64)] * 3, 2)] == [0, 0, 0]


def test_wide_parities_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, own, dtype=np.uint64)])) for n, own in ((0, 0), (1, 0), (900, 90), (1000, 30), (1020, 3), (1100, 200), (1900, 100), (2100, 9), (4990, 10))]
    blobs = sketches.wide_parities(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
    wide = sketches.Wide(blobs)
    assert [len(b) * 8 for b in blobs] == [2048, 2048, 2048, 4096, 2048, 4096, 4096, 8192, 16384]
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets)), indexing="ij"))
    differ = wide.differ(x, y)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (differ <= true).all() and (differ[x == y] == 0).all()
    near = (wide.size[x] <= 2 * wide.size[y]) & (wide.size[y] <= 2 * wide.size[x]) & (true > 0) & (true < 400)
    assert (differ[near] >= 0.8 * true[near]).all() and (wide.size[x] != wide.size[y])[near].any()
    assert (differ % 2 == true % 2)[near].all()


@pytest.mark.parametrize("percent, k", [(90, 3), (80, 5)])
def test_lists_of_chance_are_settled_where_they_meet(spark, monkeypatch, percent, k):
    """Texts of 20 of 150 phrases: nearly all shingles are in some 25 texts that are no near copies.  None of their entries goes on to the tiles, and no link between the few near copies is lost."""
    whole, left = set_join._mixed, []

    def counted(entries, label):
        out = tiles.materialise(whole(entries, label))
        left.append(out.count())
        return out

    monkeypatch.setattr(set_join, "_mixed", counted)
    rng = random.Random(4)
    phrases = [[f"f{i}_{j}" for j in range(10)] for i in range(150)]
    texts = [[w for f in rng.sample(phrases, 20) for w in f] for _ in range(180)]
    texts += [_edited(rng, texts[i % 40], rng.choice((1, 2, 3, 4, 5, 6, 7))) for i in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got, _ = _run(spark, monkeypatch, rows, percent, k)
    assert got == _expected(rows, percent, k)
    assert 120 < len({c for _, _, c in got}) < 300
    assert sum(left) == 0


def test_small_groups_give_their_pairs_or_come_back_whole(spark):
    """Groups of many sizes, some with few pairs that pass and some with many: each is settled or given back, and nothing is lost."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 2, 3, 9, 20, 40, tiles.SMALL, tiles.SMALL]
    rows = [(g, 1000 * g + i, int(rng.integers(0, 30)), int(rng.integers(0, 2 if g % 2 else 400))) for g, n in enumerate(sizes) for i in range(n)]
    frame = tiles.materialise(spark.createDataFrame(rows, "token long, key long, place int, kind int"))
    told = tiles.settled(frame, "token", "place", lambda c: c["place"] + 8, lambda c, x, y: np.where(c["kind"][x] == c["kind"][y], 1, 0)).collect()
    pairs, back = {}, {}
    for g, n in enumerate(sizes):
        mine = [r for r in rows if r[0] == g]
        pairs[g] = {(x[1], y[1]) for x in mine for y in mine if x[1] < y[1] and x[3] == y[3] and abs(x[2] - y[2]) <= 8}
        if len(pairs[g]) > tiles.FEW * n:
            back[g] = mine
    assert back and len(back) < len(sizes)
    assert sorted((r["x"], r["y"]) for r in told if r["x"] is not None) == sorted(p for g in pairs if g not in back for p in pairs[g])
    assert sorted((r["token"], r["key"], r["place"], r["kind"]) for r in told if r["x"] is None) == sorted(r for rs in back.values() for r in rs)
