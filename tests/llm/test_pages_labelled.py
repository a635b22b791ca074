"""Main text of labelled pages: reader comments and boilerplate of many kinds, and the style tree alone."""

import random

import pytest

from cityweave.llm import pages

HEAD = "<!DOCTYPE html><html><head><title>t</title><script>var a='<p>';</script></head>"
MAIN = "<h1>The mill at dawn</h1><p>Rivers were calm &amp; wide.</p><p>Nobody   came\n that day.</p>"
WANT = "The mill at dawn\nRivers were calm & wide.\nNobody came that day."
SAID = "<p>First! Great post</p><p>I do not agree at all</p>"
# what may stand behind, around or inside the article, none of which is its text
BEHIND = [
    f'<article class="comment">{SAID}</article>', f'<section id="comments">{SAID}</section>', f'<div class="user-comments">{SAID}</div>', f'<div class="post-comments"><ul><li>{SAID}</li></ul></div>',
    f'<div id="disqus_thread">{SAID}</div>', f'<div class="commentList">{SAID}</div>', f'<ol class="comment-list">{SAID}</ol>', f'<div id="respond">{SAID}</div>', f'<div itemprop="comment">{SAID}</div>',
    f'<div itemscope itemtype="https://schema.org/Comment">{SAID}</div>', f'<div role="comment">{SAID}</div>', f'<section class="reader-replies">{SAID}</section>',
    '<div class="adSlot"><p>Buy now</p></div>', '<div class="newsletterSignup"><p>Join us</p></div>', '<div class="ad ad-300"><p>Buy now</p></div>', '<aside><p>See also</p></aside>',
    '<div class="related-links"><ul><li>Other</li></ul></div>', '<form><p>Your mail</p><input></form>', '<div class="cookieConsent">We use cookies</div>', '<nav><ul><li>Home</li></ul></nav>',
    '<div class="share-buttons">Share</div>', '<div hidden><p>unseen</p></div>', '<div style="display: none">unseen</div>', '<dialog>Hello</dialog>', '<div role="complementary">more</div>',
]
OUTSIDE = ["<header><p>Site name</p></header>", "<footer><p>&copy; 2020</p></footer>", '<div class="sidebar"><article><p>teaser</p></article></div>']
# what is part of it, although its names look otherwise
INSIDE = [
    '<div class="has-sidebar">{}</div>', '<div class="content no-comments">{}</div>', '<section id="related-work">{}</section>', '<div class="share-price">{}</div>', '<div class="comments-enabled">{}</div>',
    '<div id="widget-area-main">{}</div>', "<article><section>{}</section></article>",
]


def labelled():
    out = []
    for i, x in enumerate(BEHIND):
        out.append((f"inside {i}", f"{HEAD}<body><article>{MAIN}{x}</article></body></html>"))
        out.append((f"behind {i}", f"{HEAD}<body><nav><ul><li>Home</li></ul></nav><article>{MAIN}</article>{x}</body></html>"))
    out += [(f"outside {i}", f"{HEAD}<body>{x}<article>{MAIN}</article></body></html>") for i, x in enumerate(OUTSIDE)]
    out += [(f"wrapped {i}", f"{HEAD}<body><article>{x.format(MAIN)}</article></body></html>") for i, x in enumerate(INSIDE)]
    out.append(("main", f'{HEAD}<body class="has-sidebar"><main><article>{MAIN}<article><p>I was there</p></article></article></main></body></html>'))
    out.append(("nested", f"{HEAD}<body><article><article>{MAIN}</article></article></body></html>"))
    return out


@pytest.mark.parametrize("kind,page", labelled(), ids=[k for k, _ in labelled()])
def test_labelled_page(kind, page):
    assert "\n".join(pages._main(list(pages.blocks(page)))) == WANT


def test_labelled_pages_of_many_sites(spark):
    rows = [(i, f"http://h{i}.example.com/{i}", p) for i, (_, p) in enumerate(labelled())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.text for r in pages.main_text(df).collect()} == {WANT}


def site(rng, host, n, first):
    """Pages without an article element and without telling names."""
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "sk", "u"]) for _ in range(rng.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k))
    out = []
    for i in range(n):
        body = [line(rng.choice([4, 12, 30, 70, 150])) for _ in range(rng.randint(1, 14))]
        links = "".join(f"<li><a>{word()}</a></li>" for _ in range(6))
        page = f"<body><div class=k1><ul>{links}</ul></div><div class=k2>{line(9)}</div><div class=k3><h1>{line(5)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=k4>{line(8)} everywhere</div></body>"
        out.append((first + i, f"http://{host}/{i}", page, "\n".join(body)))
    return out


def test_shape_tells_menus_from_articles(spark):
    """Words differ from page to page in all parts, so only the presentation can tell."""
    rng = random.Random(4)
    rows = [*site(rng, "a.com", 30, 0), *site(rng, "b.com", 12, 100)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    for i, _, page, body in rows:
        title = page.partition("<h1>")[2].partition("</h1>")[0]
        assert got[i] == f"{title}\n{body}"
    off = {r.page_id: r.text for r in pages.main_text(df, tree=False).collect()}
    assert all(off[i] != got[i] for i in got)


def plain_importance(found):
    """The composite importance of the nodes of one site, by recursion over its pages."""
    import math
    from collections import Counter, defaultdict

    m, shown, texts, below = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for blocks, shapes in found:
        nodes = {">".join(p.split(">")[: i + 1]) for p, *_ in blocks for i in range(1, len(p.split(">")))}
        m.update(nodes)
        for n in nodes:
            below[n.rpartition(">")[0]].add(n)
        for path, shape in {(p, f"s{s}") for p, s in shapes if p in nodes} | {(p, f"l{pages.magnitude(len(t.split()))}") for p, t, *_ in blocks}:
            shown[path][shape] += 1
        for path, text in {(p, t) for p, t, *_ in blocks}:
            texts[path][text] += 1

    def value(n):
        base, c = math.log(max(2, m[n])), shown[n]
        total = sum(c.values())
        spread = min(1.0, max(0.0, -sum(k / total * math.log(k / total) for k in c.values()) / base)) if total else 0.0
        parts = [value(x) for x in below[n]]
        if texts[n]:
            parts.append(1 - min(1.0, sum(math.log(k) for k in texts[n].values()) / len(texts[n]) / base))
        left = pages.GAMMA ** len(c)
        return (1 - left) * spread + left * sum(parts) / len(parts)

    return {pages._short(n): value(n) for n in m}


def test_composite_importance_against_recursion(spark):
    rows = site(random.Random(8), "c.com", 9, 0)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.path: r.composite for r in pages.composite(pages._measured(df)).collect()}
    want = plain_importance([pages.outline(r[2]) for r in rows])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_large_style_tables_are_joined(spark, monkeypatch):
    monkeypatch.setattr(pages, "BROADCAST_ROWS", 0)
    rows = site(random.Random(4), "a.com", 20, 0)
    df = spark.createDataFrame([r[:3] for r in rows] + [(900, None, None)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert len(got) == 21 and got[900] == "" and all("everywhere" not in t for t in got.values())


def test_deep_pages_end():
    page = "<div>" * 3000 + "<p>deep text</p>"
    (path, text, *_), *rest = pages.blocks(page)
    assert text == "deep text" and not rest and path.count(">") <= pages.DEEPEST
