"""Spelling groups, token alignment and MinHash against plain versions on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm import bytewords as bw
from ledgerline.llm import minhash, set_join, sketches, spelling_groups, tiles, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, key string, block string"


def _docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "k", "b") for i, t in rows], SCHEMA)


# --- spelling groups -------------------------------------------------------------------------


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _variants(rows, typo_modulus):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_modulus and h % typo_modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    known = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in known if v != w and _near(v, w)] for w in known}
    best = {w: min(v, key=lambda x: (-known[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if known[b] >= 5 * known[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), known[form[w]] if w in form else None) for w, n in known.items()}


def _spelled(spark, rows, typo_modulus=None):
    words = spelling_groups.materialise(spelling_groups.vocabulary(_docs(spark, rows), typo_modulus=typo_modulus))
    got = [tuple(r) for r in spelling_groups.variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_groups_equal_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abÀé÷z", k=rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = [w if rng.random() < 0.8 else "".join(rng.choices("abÀé÷z", k=1)).join([w[:3], w[3 + rng.randint(0, 1) :]]) for w in rng.choices(base, [1 + k * k for k in range(40)], k=20)]
        rows.append((i, rng.choice([" ", "\n", "3", "Ā", "-"]).join(words)))
    for modulus in (None, 7):
        want = _variants(rows, modulus)
        assert any(w[1] for w in want)
        assert _spelled(spark, rows, modulus) == want


def test_spelling_chains_ties_and_odd_rows(spark):
    # A chain of forms of four steps; a tie of forms; copies; null and empty texts; a null id; capitals that are no ASCII stay.
    rows = [(k, " ".join(["abcdefgh"] * 5 + ["abcdefgx"] * 1)) for k in range(625)]
    rows += [(0, "ABCDEFGY abcdefyy " * 5), (0, "ABCDEFGY abcdefyy " * 5), (None, "ééééééé " * 9 + "ÉÉÉÉÉÉÉ " * 9), (7, None), (8, ""), (9, "aaaaaa " * 5 + "aaaaaaa " * 25 + "aaaaaaaa " * 125 + "aaaaaaaaa " * 625)]
    rows += [(10, "kkkkkka " * 25 + "kkkkkkb " * 25 + "kkkkkkc " * 5)]
    got = _spelled(spark, rows)
    assert got == _variants(rows, None)
    assert ("aaaaaa", "aaaaaaa", "aaaaaaaaa", 5, 1, 25) in got and ("kkkkkkc", "kkkkkka", "kkkkkka", 5, 2, 25) in got


def test_spelling_very_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(spelling_groups, "PIECE", 1 << 12)
    rows = [(1, "q" * 3000 + " " + "stones " * 30_000), (2, " ".join(["z" * 400] * 30)), (3, " ".join(["z" * 399 + "y"] * 5 + ["z" * 399] * 5))]
    got = {f"{r[0][:6]}{len(r[0])}{r[0][-1]}": r for r in _spelled(spark, rows)}
    assert got["stones6s"][3] == 30_000 and got["zzzzzz399z"][1] == "z" * 400 and len(got) == 4


def test_spelling_of_an_empty_table(spark):
    assert _spelled(spark, [], 199) == set() and _spelled(spark, [(1, None)], 199) == set()


# --- token alignment -------------------------------------------------------------------------


def _aligned(rows):
    a, b = token_alignment.ByteLevel(A), token_alignment.Pieces(B)
    per, count = [], Counter()
    for i, text in rows:
        groups, links = [], []
        ids_a, ids_b = ([], []) if not text else (a.whole.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text))
        parts_a, parts_b = [a.entries[x] for x in ids_a], [b.entries[x] for x in ids_b]
        if text and not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        ends = {}
        at = 0
        for k, part in enumerate(parts_a):
            at += len(part)
            ends[at] = k + 1
        at = la = lb = 0
        for k, part in enumerate(parts_b):
            at += len(part)
            if at in ends:
                groups.append((ids_a[la : ends[at]], ids_b[lb : k + 1]))
                links.append((ids_a[ends[at] - 1], ids_b[k]))
                la, lb = ends[at], k + 1
        count.update(links)
        per.append((i, len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return sorted(((i, na, nb, len(g), len(li), sum(count[p] == most[p[1]] for p in li), sum(count[p] for p in li), digest(g)) for i, na, nb, g, li in per), key=str)


TEXTS = [
    None, "", " ", "a", "Hello, world!  It's <|endoftext|> </s> <unk> <0x0A> fine.", "Straße, naïve — façade\n\n\t1234567  ", "日本語のテキスト 🤗👩‍👧 é é", "a▁b", "x" * 5000, " \n" * 400, "मानक हिन्दी", " nbsp sep\u0085nel", "\x00\x01\x7f",
]


def test_alignment_equals_a_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "again Hello, world!")]
    rng = random.Random(2)
    rows += [(100 + k, "".join(rng.choices(["the ", "Quick", "ß", "fox ", "\n", "12", "…", "a" * 9, "' s", "日本"], k=rng.randint(1, 60)))) for k in range(150)]
    got = token_alignment.alignment(_docs(spark, rows), A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _aligned(rows)


def test_alignment_over_small_blocks(spark, monkeypatch):
    """Blocks of one text each give the same counts over the corpus."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, "Hello, world! Hello")]
    monkeypatch.setattr(token_alignment, "BLOCK", 8)
    assert sorted((tuple(r) for r in token_alignment.alignment(_docs(spark, rows), A, B).collect()), key=str) == _aligned(rows)


def test_aligned_groups_cover_the_text(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    a, b = token_alignment.ByteLevel(A), token_alignment.Pieces(B)
    for r in token_alignment.aligned_groups(_docs(spark, rows), A, B).collect():
        body, at = (" " + (TEXTS[r["id"]] or "")).encode(), 0
        for g in r["groups"]:
            assert g["start"] == at and b"".join(a.entries[x] for x in g["a"]) == b"".join(b.entries[x] for x in g["b"]) == body[at : g["end"]]
            at = g["end"]
        assert at == (len(body) if r["groups"] else 0) and bool(r["groups"]) == (TEXTS[r["id"]] not in (None, "", "a▁b"))


def test_both_byte_level_libraries_split_alike():
    a = token_alignment.ByteLevel(A)
    assert a.fast is not None
    for i in range(1, token_alignment.PLAIN):
        c = chr(i)
        for text in (c, c * 2 + "a", f"a{c}b", f" {c} {c}{c}1", f"{c}\n {c}", f"I{c}m {c}'s"):
            assert a.fast.encode_ordinary(text) == a.whole.encode(text, add_special_tokens=False).ids


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.alignment(_docs(spark, []), A, B).collect() == []


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(n) < 0.3)
        bits = token_alignment._bitset(n, at)
        assert token_alignment._select(bits).tolist() == at.tolist()
        assert token_alignment._rank(bits, np.arange(n)).tolist() == [int((at < k).sum()) for k in range(n)]


# --- MinHash ---------------------------------------------------------------------------------


def _sets(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _components(rows, percent, k):
    sets = [_sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    order = lambda v: (v is None, v or 0)
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0], key=order)
    return sorted(((rows[x][0], len(sets[x]), least[find(x)]) for x in range(len(rows))), key=str)


def _near_copies(rng, n):
    vocab = [f"w{k}" for k in range(60)]
    rows, bases = [], [rng.choices(vocab, k=rng.choice([3, 5, 9, 40, 120])) for _ in range(12)]
    passage = rng.choices(vocab, k=40)
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.2:
            words = words + passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words).upper() if rng.random() < 0.5 else " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = _near_copies(rng, 260) + [(None, "null id " * 3), (None, "null id " * 3), (5, None), (6, ""), (7, " \n"), (5, "twice the same id " * 4), (5, "twice the same id " * 4), (900, "one two"), (901, "One  Two"), (902, "one"), (903, "x " * 50_000)]
    got = minhash.near_duplicates(_docs(spark, rows)).select("doc", "n_shingles", "component").collect()
    assert sorted((tuple(r) for r in got), key=str) == _components(rows, 80, 4)


def test_minhash_in_small_tiles(spark, monkeypatch):
    """A band's value that more classes have than a tile holds is compared block by block."""
    monkeypatch.setattr(tiles, "SMALL", 2)
    whole = tiles.compared
    monkeypatch.setattr(minhash, "compared", lambda *a: whole(*a[:5], 3))
    rows = _near_copies(random.Random(3), 200)
    got = minhash.near_duplicates(_docs(spark, rows)).select("doc", "n_shingles", "component").collect()
    assert sorted((tuple(r) for r in got), key=str) == _components(rows, 80, 4)


def test_minhash_tiles_compare_every_pair_of_components_once(spark):
    """All classes share one band's value, none is linked yet: each pair that the sizes allow is met, whatever the tiles."""
    rng = np.random.default_rng(4)
    least = minhash.minima(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    packed = minhash.signature(least[None, :])[0].tobytes()
    n = [int(x) for x in rng.integers(80, 110, 40)]
    classes = spark.createDataFrame([(k, n[k], bytearray(packed), bytearray(256)) for k in range(40)], "number long, n int, packed binary, odd binary")
    entries = spark.createDataFrame([(k, 1) for k in range(40)], "key long, band long")
    label = spark.createDataFrame([(k, 0) for k in range(10)], "key long, label long")
    want = {(x, y) for y in range(40) for x in range(y) if min(n[x], n[y]) * 100 >= 80 * max(n[x], n[y]) and not y < 10}
    for tile in (4096, 7):
        got = [tuple(r) for r in minhash._inside(entries, classes, label, 80, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(_docs(spark, [])).collect() == []


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    for like in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 2000).astype(np.uint64)
        shared = int(2000 * 2 * like / (1 + like)) // 1
        x, y = both[:2000], np.concatenate([both[:shared], rng.integers(0, 2**63, 2000 - shared).astype(np.uint64)])
        sx, sy = (minhash.signature(minhash.minima(s)[None, :])[0] for s in (x, y))
        assert abs(float(minhash.estimated(sx, sy)) - shared / (4000 - shared)) < 0.15


def test_bands_catch_pairs_at_the_threshold():
    """Recall of the bands at 0.8, over random pairs: none of 2,000 missed."""
    rng = np.random.default_rng(7)
    for _ in range(2000):
        s = bw.mix(rng.integers(0, 2**63, 110).astype(np.uint64))
        x, y = minhash.minima(s[:100]), minhash.minima(np.concatenate([s[:89], s[100:110]]))
        assert (minhash.bands(x) == minhash.bands(y)).any()


def test_parities_part_no_linked_sets():
    rng = np.random.default_rng(11)
    parted = 0
    for size in (1, 5, 40, 300, 4000):
        for _ in range(60):
            both = bw.mix(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
            x, y = np.unique(both[:size]), np.unique(both[rng.integers(0, max(1, size // 2)) :][:size])
            odd = [sketches.parities(t, np.array([0, len(t)])) for t in (x, y)]
            shared = len(np.intersect1d(x, y))
            link = 100 * shared >= 80 * (len(x) + len(y) - shared)
            told = sketches.parted(*odd, np.array([len(x)]), np.array([len(y)]), 80)[0]
            assert not (link and told)
            parted += told and not link
    assert parted > 100


@pytest.mark.parametrize("percent", [80, 90])
def test_no_linked_pair_is_ended_in_a_tile(spark, percent):
    """Entries of random linked sets: the test lets each pair through at its first common shingle, whatever a leader tells."""
    rng = np.random.default_rng(17)
    bodies, sets = [], {}
    for i in range(400):
        size = int(rng.integers(1, 200))
        base = [f"w{i}_{j}" for j in range(size + 2)]
        near = [w if rng.random() > 0.02 else f"x{i}_{j}" for j, w in enumerate(base)] + [f"y{i}_{j}" for j in range(int(rng.integers(0, 3)))]
        third = [w if rng.random() > 0.03 else f"z{i}_{j}" for j, w in enumerate(base)]
        for k, words in enumerate((base, near, third)):
            bodies.append((3 * i + k, bytearray(" ".join(words).encode())))
            sets[3 * i + k] = _sets(" ".join(words), 3)
    df = spark.createDataFrame(bodies, "key long, body binary")
    index = set_join._index(df, set_join._usage(df, 3), percent, 3).toPandas()
    rows = {key: part.set_index("token") for key, part in index.groupby("key")}
    linked = 0
    for i in range(400):
        x, y, lead = 3 * i, 3 * i + 1, 3 * i + 2
        both = len(sets[x] & sets[y])
        if 100 * both < percent * len(sets[x] | sets[y]):
            continue
        linked += 1
        tokens = [t for t in rows[x].index if t in rows[y].index]
        columns = {c: np.array([rows[k].loc[t, c] if not (c in ("p1", "p2") and np.isnan(rows[k].loc[t, c])) else 0 for t in tokens for k in (x, y)]).astype(np.int64) for c in ("n", "place", "band", "w0", "w1", "w2", "w3", "p1", "p2")}
        columns |= {"key": np.array([x, y] * len(tokens)), "lead": np.full(2 * len(tokens), lead), "lead_n": np.full(2 * len(tokens), len(sets[lead])), "own": columns["band"] == np.repeat(columns["band"].reshape(-1, 2).min(axis=1), 2)}
        columns["over"] = np.array([len(sets[x] & sets[lead]), len(sets[y] & sets[lead])] * len(tokens))
        marks = set_join._derivable(percent)(columns, np.arange(0, 2 * len(tokens), 2), np.arange(1, 2 * len(tokens), 2))
        # The entry that stands earlier looks as far as the other one stands.
        places, reach = columns["place"].reshape(-1, 2), set_join._reach(percent)(columns).reshape(-1, 2)
        met = [reach[t, places[t].argmin()] >= places[t].max() for t in range(len(tokens))]
        assert ((marks > 0) & np.array(met)).any()
    assert linked > 150


def test_minhash_and_set_join_agree(spark):
    rows = _near_copies(random.Random(9), 200)
    docs = _docs(spark, rows)
    find = lambda m: sorted(tuple(r) for r in m.near_duplicates(docs, percent=85, k=5).select("doc", "n_shingles", "component").collect())
    assert find(minhash) == find(set_join)


def test_a_passage_in_many_sets_of_one_size_makes_few_pairs(spark, monkeypatch):
    """1,500 texts that are one passage but for a few words of their own, just below the threshold: of 1.1 million pairs next to none leaves the tiles."""
    passage = " ".join(f"p{k}" for k in range(96))
    rows = [(i, f"{passage} a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(1500)] + [(5000, f"{passage} a7 b7 c7 d7 e7 x"), (5001, passage)]
    # Texts of their own are linked with the bare passage (94 of 100 shingles), and so all together; without it, with none.
    left, _expected = {}, []
    sets = {i: _sets(t, 3) for i, t in rows}
    near = lambda x, y: 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y])
    rows = [r for r in rows if r[0] != 5001]
    assert not near(1, 2) and near(7, 5000) and near(7, 5001) and not near(8, 5000)
    _expected = sorted((i, len(sets[i]), 7 if i == 5000 else i) for i, _ in rows)
    for module, percent in ((set_join, 90), (minhash, 90)):
        whole = module.compared

        def counted(*a, whole=whole, module=module):
            out = tiles.materialise(whole(*a))
            left[module] = out.count()
            return out

        monkeypatch.setattr(module, "compared", counted)
        got = module.near_duplicates(_docs(spark, rows), percent=percent, k=3).select("doc", "n_shingles", "component").collect()
        assert sorted(tuple(r) for r in got) == _expected
    assert left[minhash] < 56_000 and left[set_join] < 400_000  # one in twenty by 2,048 bits, one in three by 256
