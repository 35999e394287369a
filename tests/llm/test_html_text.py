import itertools
import random

import pytest

from loomspan.llm import html_text as H


def cost(capacity, edges, side):
    return sum(-c for c, s in zip(capacity, side, strict=True) if c < 0 and s) + sum(c for c, s in zip(capacity, side, strict=True) if c > 0 and not s) + sum(c for (a, b), c in edges.items() if side[a] != side[b])


def test_cut_is_least():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        capacity = [rng.choice([0, rng.randint(-30, 30), rng.randint(-5, 5)]) for _ in range(n)]
        edges = {(a, b): rng.randint(0, 12) for a in range(n) for b in range(a) if rng.random() < 0.5}
        got = H.source_side(capacity, edges)
        assert cost(capacity, edges, got) == min(cost(capacity, edges, s) for s in itertools.product([False, True], repeat=n))


BODY = "<p>The first paragraph of the story says a good deal, and more.</p><p>A second one follows &amp; adds <b>bo</b>ld\n words.</p><p>Short end.</p>"
TEXT = "The first paragraph of the story says a good deal, and more. A second one follows & adds bold words. Short end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1>{BODY}</article><footer>&copy; us</footer>", "Title " + TEXT),
        (f"<header><h1>Site</h1></header><main><h2>Title</h2>{BODY}</main><aside>Other things to read in this place.</aside>", "Title " + TEXT),
        (f"<div class='top-menu'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class=content>{BODY}</div><div id=footer>Imprint</div>", TEXT),
        (f"<article><header><h1>Title</h1></header>{BODY}<div class=ad>Buy this fine thing today, it is cheap.</div></article><section id=comments><article class=comment><p>I liked this story very much, thank you all.</p></article></section>", "Title " + TEXT),
        (f"<div class='cookie-notice'>We use cookies to serve you better, and you agree to it.</div><article>{BODY}</article><form>Your name <input></form>", TEXT),
        (f"<style>p{{}}</style><script>var t='</p>';</script><article>{BODY}</article><!-- <p>gone</p> --><noscript>no</noscript>", TEXT),
        (f"<article><div style='display: none'>Hidden words.</div>{BODY}", TEXT),
        (f"<table><tr><td>{BODY}</td></tr></table>", TEXT),
        (f"<ul class=nav><li><a href=1>A</a></li></ul>{BODY}<ul class=related><li><a href=2>Read this other story too</a></li></ul>", TEXT),
        (f"<article><h1>T</h1><p><b>Open one.<br><p>Next <i>and</i> last.</article><footer>x</footer>{''}", "T Open one. Next and last."),
        ("<article><ul><li>First thing.</li><li>Second thing.</li></ul></article>", "First thing. Second thing."),
        ("", ""),
        ("<nav>only</nav>", ""),
        ("<article></article>", ""),
        ("<article><p>1 &lt; 2 and a &#xe9; b</article>", "1 < 2 and a é b"),
        ("<article><p>less < more <b", "less < more <b"),
        (f"<article>{BODY}<p class='social-history'>The social history of the town is long.</p><div class='share-price'>The price of a share rose by three.</div><section id='promotion-rules'><p>Rules of promotion are old ones.</p></section></article>", TEXT + " The social history of the town is long. The price of a share rose by three. Rules of promotion are old ones."),
        ("<article><p>One <![CDATA[two]]> three here.</p></article>", "One three here."),
        (f"<article>{BODY}<p>A sum <math><mi>x</mi></math> of <svg><text>no</text></svg>them.</p><div><object><p>no</div><p>Last words here.</p></article>", TEXT + " A sum x of them. Last words here."),
        (f"<article><select><option>no<option>none</select><p>Some <noscript><p>no</p></noscript>more words.</p>{BODY}</article>", "Some more words. " + TEXT),
        (f"<div class='main-nav'>Here you find all of it.</div><div>{BODY}</div><div class='post-comments'><div class='comment-body'>I think that this is a fine story, and long.</div></div>", TEXT),
    ],
)
def test_pages(page, text):
    assert H.extract(page) == text
    if page:
        assert H.extract("<!DOCTYPE html><html lang=en><head><title>T</title></head><body class='has-sidebar'>" + page) == text


def test_frame(spark):
    long = "<article>" + "<p>Some words of a long story, told on and on.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3_000 + BODY
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (2, None, None, ""), (None, "v", "", ""), (1, "u", long, ""), (5, "w", deep, ""), (6, "w", "<" * 20_000, ""), (7, "w", "<a b='" * 3_000, "")]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url, r.n_chars > 1000): r.text for r in got}
    assert by[(1, "u", False)] == TEXT == by[(5, "w", False)] and by[(2, None, False)] == "" and by[(1, "u", True)].count("story") == 20_000
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_neighbours_turn_blocks_that_are_in_doubt():
    """A short line without signs among paragraphs is content, the same line alone is not; a
    paragraph between menu entries of its kind goes with them."""
    page = H.parse(f"<div>{BODY}<p>Short line</p>{BODY}</div>")
    odds = {b.text: H.log_odds(page, b) for b in page.blocks}
    assert odds["Short line"] < 0 and "Short line" in H.extract(f"<div>{BODY}<p>Short line</p>{BODY}</div>")
    assert H.extract("<div><p>Short line</p></div>") == ""
    links = "".join(f"<p><a href={i}>Some page {i}</a></p>" for i in range(3))
    mixed = f"<div>{links}<p>And much more, to read.</p>{links}</div>"
    page = H.parse(mixed)
    assert max(H.log_odds(page, b) for b in page.blocks) > 0 and H.extract(mixed) == ""


def random_page(rng, blocks):
    """Nested elements with known and unknown names around texts of any kind."""
    texts = ["Home", "A line of words, and a few more of them.", "Short", "© all rights reserved", "One two three four five six seven eight nine ten eleven twelve.", "<a href=x>Read more</a>"]
    out, stack = [], []
    for _ in range(blocks):
        while rng.random() < 0.5 and len(stack) < 5:
            stack.append(rng.choice(["div", "section", "ul", "article", "nav", "td"]))
            out.append(f"<{stack[-1]}{rng.choice(['', '', ' class=ad', ' class=share-price', ' class=content', ' id=top'])}>")
        tag = rng.choice(["p", "li", "h2"])
        out.append(f"<{tag}>{rng.choice(texts)}</{tag}>")
        while stack and rng.random() < 0.4:
            out.append(f"</{stack.pop()}>")
    return "".join(out)


def test_whole_extraction_against_every_labelling():
    rng, turned = random.Random(8), 0
    for _ in range(150):
        source = random_page(rng, rng.randint(1, 7))
        page = H.parse(source)
        capacity, edges = H.graph(page)
        if len(capacity) > 15:
            continue
        got = H.source_side(capacity, edges)
        costs = {s: cost(capacity, edges, s) for s in itertools.product([False, True], repeat=len(capacity))}
        assert costs[tuple(got)] == min(costs.values())
        assert H.extract(source) == " ".join(b.text for b, side in zip(page.blocks, got, strict=False) if side)
        turned += any(s != (c > 0) for s, c, _ in zip(got, capacity, page.blocks, strict=False))
    assert turned > 10


def test_fit_learns_from_landmarks_and_stays_in_bounds(spark):
    rows = [(i, "u", f"<nav><a href=x>All {i}</a></nav><article>{BODY}</article><footer>© us, all rights reserved</footer>", "") for i in range(40)]
    pages = spark.createDataFrame([*rows, (None, "", "<article>null id</article>", ""), (3, "", None, "")], "page_id long, url string, html string, f string")
    weights = H.train(pages)
    assert weights != H.PRIOR and weights == H.train(pages.repartition(7))
    assert all(min(p / 2, p * 2) <= w <= max(p / 2, p * 2) for w, p in zip(weights, H.PRIOR, strict=True))
    assert H.train(pages.limit(0)) == H.PRIOR and H.extract(rows[0][2], weights) == TEXT


def test_share_of_article_text_on_the_pages(spark):
    """Of the test pages: whole articles and nothing else, by the article element itself."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    rows = pages.collect()
    same = 0
    for r in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", r.html or "")
        plain = " ".join(H.html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?(?:p|h1|br|div)\b)[^>]*>", " ", inner[1] if inner else ""))).split())
        same += plain == got[r.page_id]
    assert same >= 0.99 * len(rows)
