"""Vector and page operators against brute force, and on odd input."""

import numpy as np
import pytest

from cityweave.llm import near_vectors, neighbours, pages


def cloud(n=600, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(0, n, 5):  # near copies and equal rows
        x[i + 1] = x[i] + rng.standard_normal(dims) * 0.05
        x[i + 2] = x[i]
    x[1::5] *= 3
    return x


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int").repartition(4)


ODD = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [float("nan")] * 16, 0), (9005, [1.0] * 15 + [None], 0), (9006, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]


@pytest.mark.parametrize("leaf", [2048, 24])
def test_near_vectors_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_vectors, "LEAF", leaf)
    x = cloud()
    got = {r.vec_id: r for r in near_vectors.near_vectors(frame(spark, x, ODD)).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    up = list(range(len(x)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(close), strict=True):
        a, b = sorted((find(i), find(j)))
        up[b] = a
    assert all(got[i].n_links == close[i].sum() - 1 and got[i].component_id == find(i) and got[i].kept == (find(i) == i) for i in range(len(x)))
    assert all(got[o[0]].n_links == 0 and got[o[0]].component_id == o[0] for o in ODD)
    assert near_vectors.near_vectors(frame(spark, x).limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_nearest_recall(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(neighbours, "BUCKET", 16)
        monkeypatch.setattr(neighbours, "GROUP", 64)
    x = cloud()
    got = {}
    for r in neighbours.nearest(frame(spark, x, ODD), 20, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = set(np.lexsort((np.arange(len(x)), -score))[:10].tolist())
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hit += len(want & {v for _, v, _ in mine})
    assert set(got) == set(range(0, len(x), 20)) and hit >= 0.9 * 10 * len(got)


def test_nearest_with_few_rows(spark):
    x = np.eye(3)
    rows = neighbours.nearest(frame(spark, x, ODD), 1, 20).collect()
    assert {(r.query_id, r.vec_id) for r in rows} == {(i, j) for i in range(3) for j in range(3) if i != j}
    assert neighbours.nearest(frame(spark, x).limit(0)).count() == 0


def test_nearest_fills_up_beside_tight_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    monkeypatch.setattr(neighbours, "GROUP", 64)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 16))
    for i in range(900):  # tight groups of 75, and three rows outside of them
        if i not in (0, 300, 600):
            x[i] = x[i // 75 * 75 + 1] + rng.standard_normal(16) * 1e-6
    got = {}
    for r in neighbours.nearest(frame(spark, x), 5, 20).collect():
        got.setdefault(r.query_id, set()).add((r.rank, r.vec_id))
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in range(0, 900, 5)}


def test_nearest_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2, (500, 12)).astype(float), axis=0)
    x = x[x.any(axis=1)]
    rng.shuffle(x)
    x[0] = 1.0
    got = {}
    for r in neighbours.nearest(frame(spark, x), 40, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, len(x), 40):
        score = x @ x[q]
        score[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(len(x)), -score))[:5].tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy</div><div class=promo-box>Offer {0}</div>
<{1}><h1>Title {0}</h1><p>First &amp; best&nbsp;{0}<br>line<p><b>Bold {0}</b> text<script>var x = "</p>";</script></p>
<form>Name <input></form><div id="comments">I agree {0}</div></{1}><aside>See also</aside><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text(spark, tag):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(i, tag)) for i in range(8)]
    rows += [(100, None, None), (101, "", ""), (102, "http://b.example.com", "plain &lt;text&gt;\n only"), (103, "http://b.example.com", "<p>un<b>closed"), (104, "http://c", "<article><p>x</p>"), (104, "http://c", "<article><p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(got[i] == f"Title {i}\nFirst & best {i} line\nBold {i} text" for i in range(8))
    assert (got[100], got[101], got[102], got[103], got[104]) == ("", "", "plain <text> only", "unclosed", "x")
    assert pages.main_text(df).count() == len(rows) and pages.main_text(df.limit(0)).count() == 0


def test_style_tree_scores_repeated_content_low(spark):
    rows = [(i, f"http://a.example.com/{i}", f"<body><div class=x>always</div><div class=y>text {i}</div></body>") for i in range(20)]
    tree = pages.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    low, high = sorted(r.importance for r in tree)
    assert low < 0.1 < 0.8 < high
    got = {r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"text {i}" for i in range(20)}


@pytest.mark.parametrize(
    "start,end",
    [
        ('<body class="has-sidebar"><article>', "</article>"),
        ('<body class="page no-comments widget"><main id="search">', "</main>"),
        ('<div class="content no-sidebar"><article>', "</article></div>"),
        ('<div id="widget-area-main"><article class="related">', "</article></div>"),
        ('<div class="widget"><article>', "</article></div>"),
        ('<div class="page has-sidebar">', "</div>"),
    ],
)
def test_class_words_do_not_take_the_text(start, end):
    inner = '<section id="related-work">A</section><h2 id="search">B</h2><p id="form">C</p><div class="share-price">D</div><p><math>E</math></p><menu><li>F</menu><fieldset>G</fieldset>'
    inner = inner if "<article" in start or "<main" in start else inner.replace("menu>", "ul>")
    got = [t for _, t, _, lost, _ in pages.blocks(f'<html class="nav">{start}{inner}<div class="promo-box">x</div><div id="comments">y</div>{end}') if not lost]
    assert got == list("ABCDEFG")


def test_articles_of_a_sidebar_stay_out():
    page = '<article>whole</article><div class="sidebar"><article>teaser</article></div>'
    assert [t for _, t, _, lost, _ in pages.blocks(page) if not lost] == ["whole"]


def test_style_tree_acts_inside_the_article_and_on_branches(spark):
    box = '<div class="x1"><p>Follow our channel</p><ul><li>every day</li></ul></div>'
    page = "<body><div class=y><{0}><h1>Title {1}</h1><p>Text {1}</p>{2}</{0}></div></body>"
    rows = [(100 * h + i, f"http://{tag}.com/{i}", page.format(tag, i, box)) for h, tag in enumerate(("article", "div")) for i in range(12)]
    copies = [(1000 + i, f"http://c.com/{i}", page.format("article", 5, "")) for i in range(30)]  # of one page
    copies += [(1100 + i, f"http://c.com/x{i}", page.format("article", i, "")) for i in range(6)]
    df = spark.createDataFrame(rows + copies, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert all(got[100 * h + i] == f"Title {i}\nText {i}" for h in range(2) for i in range(12))
    assert all(got[1000 + i] == "Title 5\nText 5" for i in range(30)) and all(got[1100 + i] == f"Title {i}\nText {i}" for i in range(6))
