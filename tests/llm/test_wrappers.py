"""Tree matching against its definition; extraction where only the alignment can tell content from template."""

import random
import re

import pytest
from pyspark.sql import functions as F

from respanel.llm import htmltext

PAGES = "page_id long, url string, html string, host string, layouts int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


def tree(source):
    return htmltext.Skeleton(htmltext.Page(source).skeleton())


def random_page(draw, depth=0):
    out = []
    for _ in range(draw.randint(0, 4 if depth < 3 else 0)):
        tag = draw.choice(["div", "span", "b"])
        out.append(f"<{tag}>{draw.choice(['', 'x'])}{random_page(draw, depth + 1)}</{tag}>")
    return "".join(out)


def defined(a, b, x=0, y=0):
    """Greatest number of pairs, straight from the recurrence."""
    if a.tag[x] != b.tag[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(1, len(xs) + 1):
        for j in range(1, len(ys) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + defined(a, b, xs[i - 1], ys[j - 1]))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("cells", [htmltext.CELLS, 1])
def test_matching_has_the_defined_size_and_keeps_order(monkeypatch, cells):
    monkeypatch.setattr(htmltext, "CELLS", cells)
    draw, known = random.Random(3), {}
    for _ in range(300):
        a, b = tree(random_page(draw)), tree(random_page(draw))
        pairs = htmltext.match(a, b, known)
        assert len(pairs) == defined(a, b)
        up = dict(pairs)
        parents = [{c: k for k, own in enumerate(t.children) for c in own} for t in (a, b)]
        assert len(set(up.values())) == len(up) and all(a.tag[x] == b.tag[y] for x, y in pairs)
        assert all(up[parents[0][x]] == parents[1][y] for x, y in pairs if x)
        assert sorted(up.values()) == [up[x] for x in sorted(up)]


def test_way_back_is_the_same_in_blocks(monkeypatch):
    draw = random.Random(5)
    a, b = (tree("".join(draw.choice(["<p>x</p>", "<div><b>y</b></div>", "<h2>z</h2>", "<div>q</div>"]) for _ in range(150))) for _ in range(2))
    whole = htmltext.match(a, b)
    monkeypatch.setattr(htmltext, "CELLS", 10)
    assert htmltext.match(a, b) == whole


@pytest.mark.parametrize("depth", [400, 3000])
def test_deep_unlike_trees(depth):
    a = tree("<div><b>" * depth + "x")
    b = tree("<div><b><i>q</i>" * (depth - 7) + "<p>x")
    assert len(htmltext.match(a, b)) >= 2 * (depth - 8)


def test_wide_unlike_trees_align_far_apart():
    one = ["<p>a<b>1</b></p>" if k % 3 else "<div>c</div>" for k in range(900)]
    a, b = tree("".join(one)), tree("".join(["<ul><li>x</ul>"] * 700 + one[:450] + ["<h2>n</h2>"] + one[450:]))
    assert len(htmltext.match(a, b)) == len(a.tag)


def test_names_never_take_the_article():
    for source, want in [
        ('<body class="has-sidebar"><article><h1>T</h1><p>a</p></article></body>', "T\n\na"),
        ('<body class="sidebar"><main class="comments"><p>a</p></main></body>', "a"),
        ('<article><div class="article-header"><h1>T</h1></div><p class="share-price">b</p></article>', "T\n\nb"),
        ('<div class="sidebar"><article><p>a b</p></article></div><div class="ad">x</div>', "a b"),
        ('<div class="ad"><p>one two three four</p></div><p>five</p>', "one two three four\n\nfive"),
        ("<article><header><h1>T</h1></header><p>a</p></article><header>no</header>", "T\n\na"),
    ]:
        assert htmltext.Page(source).text() == want, source


def unmarked(source):
    """The page without anything that names its parts: only its tree is left."""
    source = re.sub(r"<(/?)(article|nav|footer|ul|li)\b[^>]*>", r"<\1div>", source or "")
    return re.sub(r'<div class="ad">', "<div>", source)


def plain_article(source):
    """Blocks of the article by regular expressions."""
    import html

    m = re.search(r"<article>(.*?)</article>", source or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", m[1]))) if m else []
    flat = [" ".join(html.unescape(x).split()) for x in blocks]
    return "\n\n".join(x for x in flat if x)


def test_alignment_alone_finds_the_articles(spark, sf):
    own = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").filter(F.col("url").contains("tion"))
    rows = own.select("page_id", "url", "html").collect()
    want = {r.page_id: plain_article(r.html) for r in rows}
    marked = {r.page_id: r.text for r in htmltext.extract(own).collect()}
    assert marked == want and len(want) > 500
    bare = spark.createDataFrame([(r.page_id, r.url, unmarked(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(bare).collect()}
    off = {r.page_id: htmltext.Page(unmarked(r.html)).text() for r in rows}
    right = sum(got[i] == want[i] for i in want) / len(want)
    assert right > 0.95 and sum(off[i] == want[i] for i in want) / len(want) < 0.05


@pytest.mark.parametrize("small", [htmltext.SMALL_BYTES, 0])
def test_layouts_copies_and_constant_parts(spark, monkeypatch, small):
    monkeypatch.setattr(htmltext, "SMALL_BYTES", small)
    draw = random.Random(1)
    story = lambda: " ".join(draw.choice(["sun", "rain", "wind", "snow", "fog"]) + str(draw.randint(0, 99)) for _ in range(30))
    first = "<title>{t}</title><div><a>home</a></div><div><h1>{t}</h1><p>{s}</p><p>Share this page</p></div><div>{a}</div>"
    second = "<title>{t}</title><table><tr><td>Top</td></tr></table><div><h2>News</h2><div><h1>{t}</h1><p>{s}</p></div></div>"
    rows, want = [(0, "http://h.example/", ""), (1, "http://h.example/404", "<p>Not found</p>")], {0: "", 1: "Not found"}
    for k in range(20):
        t, s = f"Title {k}", story()
        rows.append((10 + k, f"http://h.example/a{k}", first.format(t=t, s=s, a=f"buy {k}")))
        want[10 + k] = f"{t}\n\n{s}"
        rows.append((50 + k, f"http://h.example/b{k}", second.format(t=t, s=s)))
        want[50 + k] = f"{t}\n\n{s}"
    copy = story()
    for k in range(60):  # copies of one article, most of the host: its paragraphs are no template
        rows.append((100 + k, f"http://h.example/c{k}", first.format(t="Same", s=copy, a=f"buy {1000 + k}")))
        want[100 + k] = f"Same\n\n{copy}"
    rows.append((998, "http://h.example/none", first.format(t="", s="", a="buy it all").replace("Share this page", "")))
    want[998] = ""  # an empty slot is an empty text, whatever stands beside it
    rows.append((999, "http://h.example/long", first.format(t="Long", s="</p><p>".join(f"part {k}" for k in range(3000)), a="buy")))
    want[999] = "\n\n".join(["Long", *(f"part {k}" for k in range(3000))])
    got = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows)).collect()}
    assert got == want


def test_wrappers_decide_on_pages_that_have_an_article(spark):
    """Constant parts inside an article go, and an article element that holds few of the varying words is not the slot."""
    draw = random.Random(8)
    story = lambda n: " ".join(draw.choice(["sun", "rain", "wind", "snow", "fog"]) + str(draw.randint(0, 999)) for _ in range(n))
    notice = "<article><h1>{t}</h1><p>You read this free of charge.</p><p>{s}</p><div>Sign up for our letter</div><p>{u}</p></article><p>{a}</p>"
    teaser = "<div><h1>{t}</h1><p>{s}</p><p>{u}</p></div><div><article><p>{a}</p></article></div>"
    rows, want = [], {}
    for k in range(24):
        t, s, u = f"Title {k}", story(40), story(40)
        rows.append((k, f"http://notice.example/{k}", notice.format(t=t, s=s, u=u, a=f"buy {k}")))
        rows.append((100 + k, f"http://teaser.example/{k}", teaser.format(t=t, s=s, u=u, a=f"read {k} next")))
        want[k] = want[100 + k] = f"{t}\n\n{s}\n\n{u}"
    got = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows)).collect()}
    assert got == want
    assert not any(htmltext.Page(h).text() == want[i] for i, _, h in rows)


def test_nulls_repeats_and_no_host(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "http://h.example/", None), (2, "no url", "<p>a</p>")] + [(k, None, "<p>a</p>") for k in range(3, 20)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, u, "a" if h else "", 1 if h else 0) for i, u, h in rows], key=str)
