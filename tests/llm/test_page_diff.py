"""Page differencing: lines, alignment, runs of copies, and whole sites against brute force."""

from __future__ import annotations

import html as html_lib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import page_diff
from ledgerline.llm.page_diff import ARTICLE, MARKED, PLAIN

SCHEMA = "page_id long, url string, html string"


def test_lines():
    page = "<!DOCTYPE html><title>t</title><nav>menu</nav><script>if (a<b) x='</p>'</script><article><h1>A &amp; B</h1><p>one<b> two</b>\n<aside>side</aside><p>three<br>four</article><footer>f</footer>"
    found = page_diff.lines(page)
    assert [(t, k) for t, k in found if k != MARKED] == [("A & B", ARTICLE), ("one two", ARTICLE), ("three four", ARTICLE)]
    assert [t for t, k in found if k == MARKED] == ["menu", "side", "f"]
    assert page_diff.lines(None) == page_diff.lines("") == []
    assert page_diff.lines("a < b &lt;c") == [("a < b <c", PLAIN)]


def test_text_of_an_article_stays_whatever_its_class_words():
    kept = [
        '<section class="ad-hoc-report"><p>KEPT</p></section>', '<p class="menu-prices">KEPT</p>', '<div id="banner-year">KEPT</div>', '<div class="sidebar-note">KEPT</div>', '<div class="social">KEPT</div>', "<fieldset>KEPT</fieldset>",
        "<header><h1>KEPT</h1></header>", '<p class="notice">KEPT</p>', '<div class="subscribe">KEPT</div>',
    ]
    gone = ['<div class="ad-slot">GONE</div>', '<ul class="comments"><li>GONE</ul>', '<aside>GONE</aside>', "<form>GONE</form>", "<nav>GONE</nav>", '<div class="box advertisement">GONE</div>', "<footer>GONE</footer>", '<p hidden>GONE</p>', '<div role="navigation">GONE</div>']
    for around in ("article", "main"):
        for snippet in kept + gone:
            text = [t for t, kind in page_diff.lines(f"<{around}><p>before</p>{snippet}<p>after</p></{around}>") if kind != page_diff.MARKED]
            assert text == (["before", "KEPT", "after"] if snippet in kept else ["before", "after"]), snippet


def test_class_words_do_not_cut_articles():
    page = '<article><section class="related-work"><p>Related work matters</p></section><div class="story-comment-body"><p>text</p></div><div class="ad-slot">buy</div><ul class="comments"><li>first!</ul></article>'
    assert [t for t, k in page_diff.lines(page) if k == ARTICLE] == ["Related work matters", "text"]


@pytest.mark.parametrize("part", ["<!", "<script ", "<script>", "<a ", "<a '", "<!--", "</b", "<b>", "<div>", "<p>", "</script", "<i><p></i>"])
def test_long_pages_take_time_in_proportion(part):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        page_diff.lines(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 2 + 8 * took[0]


def test_longest_common_subsequence():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    random.seed(4)
    for _ in range(400):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in "ab")
        pairs = sorted(page_diff.common(a, b))
        assert all(a[i] == b[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})
        assert len(pairs) == length(a, b)


def _texts(spark, rows):
    return sorted(((r.page_id, r.text) for r in page_diff.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_shared_lines_go(spark):
    rows = [(k, f"http://h.org/a/{k:04d}", f"<div>Site menu line</div><div>Unique text of page {k} and {k * k} more</div><p>Last line</p>") for k in range(600)]
    odd = [(700, None, "<p>x"), (701, "http://z.org/", "<p>only"), (702, "nohost", None), (5, rows[5][1], rows[5][2]), (None, "http://z.org/b", "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("text", "key", "tag", "host", "path", "hashes", "codes", "gone")})
    got = page_diff.main_text(df).collect()
    want = [(k, f"Unique text of page {k} and {k * k} more") for k in [*range(600), 5]] + [(700, "x"), (701, "only"), (702, ""), (None, "")]
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert page_diff.main_text(df.limit(0)).count() == 0


def test_short_pages_are_no_copies(spark):
    rows = [(k, f"http://h.org/{k}", f"<p>Site menu line<p>Short {k}<p>Last line") for k in range(9)]
    assert _texts(spark, rows) == [(k, f"Short {k}") for k in range(9)]


@pytest.mark.parametrize("held", [1, 1 << 24])
def test_copies_reach_the_next_run_however_far(spark, monkeypatch, held):
    """Hundreds of near copies side by side keep what they share and lose the template that the pages around them have."""
    monkeypatch.setattr(page_diff, "HELD", held)  # 1: pages are never held, so the second step compares them
    body = "".join(f"<p>Paragraph {i} of the copied story, with some more words to it" for i in range(12))
    rows = [(k, f"http://h.org/b/{k:04d}", f"<div>Menu</div>{body}<p>Edited line {k}<div>Imprint</div>") for k in range(300)]
    rows += [(1000, "http://h.org/a", "<div>Menu</div><p>Quite another page with a text of its own<div>Imprint</div>"), (1001, "http://h.org/c", "<div>Menu</div><p>And a third one that has nothing to do with it<div>Imprint</div>")]
    got = dict(_texts(spark, rows))
    want = "\n".join(f"Paragraph {i} of the copied story, with some more words to it" for i in range(12))
    assert {got[k] == f"{want}\nEdited line {k}" for k in range(300)} == {True}
    assert got[1000] == "Quite another page with a text of its own" and got[1001] == "And a third one that has nothing to do with it"


@pytest.mark.parametrize("seed", range(3))
def test_random_sites(spark, seed):
    """Templates in fixed order around unlike bodies: brute force keeps a page's lines that no nearest page of another run has."""
    rng = random.Random(seed)
    rows, bodies = [], {}
    for host in range(6):
        template = [f"Template {host} {i}" for i in range(rng.randint(1, 6))]
        cut = rng.randint(0, len(template))
        for k in range(rng.randint(1, 40)):
            body = [f"Body {host} {rng.random()} {'long ' * rng.randint(10, 40)}".strip() for _ in range(rng.randint(1, 5))]
            if k and rng.random() < 0.4:
                body = bodies[rows[-1][0]]
            top = sorted(rng.sample(range(len(template)), rng.randint(0, len(template))))
            page = [template[i] for i in top if i < cut] + body + [template[i] for i in top if i >= cut]
            rows.append((len(rows), f"http://h{host}.org/{k:03d}", "".join(f"<div>{html_lib.escape(t)}</div>" for t in page)))
            bodies[rows[-1][0]] = body
    want = []
    plain = {i: re.findall(r"<div>(.*?)</div>", h) for i, _, h in rows}
    place = {i: u.rsplit("/", 1)[0] for i, u, _ in rows}

    def alike(a, b):
        same = set(plain[a]) & set(plain[b])
        return sum(len(t) for t in plain[a] if t in same) >= 0.8 * max(sum(map(len, plain[a])), sum(map(len, plain[b])))

    run = [0]
    for a, b in zip(range(len(rows)), range(1, len(rows))):
        run.append(run[-1] + (place[a] != place[b] or not alike(a, b)))
    for i in range(len(rows)):
        others = [next((j for j in side if run[j] != run[i]), None) for side in (range(i - 1, -1, -1), range(i + 1, len(rows)))]
        gone = {t for j in others if j is not None and place[j] == place[i] and not alike(i, j) for t in plain[j]}
        want.append((i, "\n".join(t for t in plain[i] if t not in gone)))
    assert _texts(spark, rows) == sorted(want, key=str)


def test_whole_articles_of_the_tables(spark):
    """Every page of the smallest table gives its article, cut out here by another route."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in page_diff.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        inner = re.sub(r"(?s)<!--.*?-->|(?i:</?(?:b|i|em|strong|a|span)\b[^>]*>)", "", re.sub(r"(?i)<br[^>]*>", " ", inner))
        blocks = [" ".join(html_lib.unescape(x).split()) for x in re.split(r"<[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)
