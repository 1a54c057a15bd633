from __future__ import annotations

import html
import re
from collections import Counter

import pytest

from threadlake.llm.crf import train
from threadlake.llm.html_blocks import leaf_blocks
from threadlake.llm.html_text import Extractor, main_text, trained
from threadlake.llm.labelled_pages import labelled_pages

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def extract():
    return Extractor(trained()).text


def truth(page):
    """The article of the test pages, whose layout is known."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    texts = (" ".join(html.unescape(re.sub(r"<(?:b|br|/b)>", " ", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {r.page_id: (r.url, truth(r.html)) for r in pages.collect()}
    rows = main_text(pages).collect()
    assert len(rows) == len(want)
    wrong = [r.page_id for r in rows if (r.url, r.text) != want[r.page_id] or r.n_chars != len(r.text)]
    assert not wrong


def test_held_out_layouts(extract):
    """Layouts of another seed, some of them ambiguous by their names: by block and by whole page."""
    extractor, whole, right, blocks_seen = Extractor(trained()), 0, 0, 0
    pages = labelled_pages(200, seed=12345)
    for page in pages:
        blocks = leaf_blocks(page)
        want = [b.text for b in blocks if any(e.marked for e in b.path)]
        got = extractor.text(page).split("\n")
        wrong = sum((Counter(want) - Counter(got)).values()) + sum((Counter(got) - Counter(want)).values())
        blocks_seen += len(blocks)
        right += len(blocks) - wrong
        whole += got == want
    assert right >= 0.99 * blocks_seen
    assert whole >= 0.95 * len(pages)


def test_unseen_layouts(extract):
    """Pages written for this test, with names that the training pages do not use together."""
    story = "<h1>Big story</h1><p>First paragraph of it.</p>{}<p>Short.</p>"
    want = "Big story\nFirst paragraph of it.\nShort."
    around = [
        "<header><a href='/'>Site</a><nav><a href='/a'>A</a></nav></header><main>{}</main><aside class='sidebar'><p>Teaser text.</p></aside><footer><p>Foo.</p></footer>",
        "<div class='site-header'>My site</div><div class='cookie-banner'>We use cookies.</div><div class='post-content'>{}</div><div id='comments'><div class='comment-body'><p>I liked this.</p></div></div><div id='footer'>Foo.</div>",
        "<nav><ul><li><a href=/>Home</a></ul></nav><article>{}</article><div class='ads-top'>Buy our stuff.</div><div class='related-posts'><h4>More</h4><p>One more story.</p></div>",
        "<div class='site-notice'>Please donate.</div><div class='menu'><ul><li>Start</li></ul></div><section>{}</section><div class='sponsored-content'><p>From a partner.</p></div>",
    ]
    for inner in ("", "<div class='advertisement'>Buy now.</div>"):
        for page in around:
            assert extract(f"<html><body>{page.format(story.format(inner))}</body></html>") == want


def test_blocks():
    page = (
        "<title>no</title><body><p>a &amp;amp; b&nbsp;&nbsp;c<b> d</b>e<br>f<p>g<script>x='</p>'</script><!-- n <p> -->"
        "<ul><li>h<li>i <a href='>'>j</a></ul>&copy; k<div title='a > b'>l</div><style>m"
    )
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["a &amp; b c de f", "g", "h", "i j", "© k", "l"]
    assert [b.path[-1].tag for b in blocks] == ["p", "p", "li", "li", "body", "div"]
    assert blocks[3].links == 1


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<<", "<p", "<!--", "<script>", "</div></p>", "<p title=\"x><p>a", "&#xD800;&#99999999;"])
def test_broken_pages(extract, page):
    assert isinstance(extract(page), str)


def test_edge_rows(spark):
    deep = "<div>" * 20_000 + "<p>deep words here.</p>"
    long = "<article>" + "<p>Some words in a paragraph, many times.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<article><p>Hello there.</p></article>", "x"),
            (None, "v", "<article><p>Hello there.</p></article>", "x"), (5, "w", long, "x"), (6, "w", deep, "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(frame).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == 6 and by_id[1][1:] == ("u", "", 0) and by_id[2][1:] == (None, "", 0)
    assert [r for r in got if r[0] is None] == [(None, "v", "Hello there.", 12)] * 2
    assert by_id[5][2].count("\n") == 19_999
    assert main_text(frame.limit(0)).count() == 0


def test_training_learns_transitions():
    chains = [[["x"], ["y"], ["y"], ["z"]], [["x"], ["y"], ["z"]]] * 5
    labels = [[0, 1, 1, 0], [0, 1, 0]] * 5
    model = train(chains, labels)
    score = lambda chain: [sum(model.weights[f] for f in block) for block in chain]
    assert [model.decode(score(c)) for c in chains] == labels
    assert model.decode([]) == []
