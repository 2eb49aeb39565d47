"""Page texts: exact messages, labelled pages that the model has not seen, broken markup."""

import html
import itertools
import random
import re

import pytest

from lodemark.llm import html_text as H


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return H.fit(H.labelled_sample(pages))


def test_messages_give_the_exact_marginals(model):
    page = '<body><nav><a href="/">Go</a></nav><div class="post"><p>Some words stand here, and more.</p><ul><li>x</ul></div>'
    tree = H.parse(page)
    n, given = len(tree.parent), H.features(tree)
    assert 8 <= n <= 11
    alike = {k: sum(k == x for x in zip(given, tree.names, strict=True)) for k in zip(given, tree.names, strict=True)}
    own = [model.own(*k, alike[k]) for k in zip(given, tree.names, strict=True)]
    total, sums = 0.0, [[0.0] * 3 for _ in range(n)]
    for states in itertools.product(H.STATES, repeat=n):
        w = model.root[states[0]]
        for i, s in enumerate(states):
            w *= own[i][s]
            if i:
                w *= model.edges.get(H.sort_of(tree, i), model.edges[""])[3 * states[tree.parent[i]] + s]
        total += w
        for i, s in enumerate(states):
            sums[i][s] += w
    for got, want in zip(model.marginals(tree), sums, strict=True):
        assert [round(x, 9) for x in got] == [round(x / total, 9) for x in want]


def test_supplied_pages(pages, model):
    """Their articles are plain: headings, paragraphs, bold text and line breaks."""
    rows = H.extract_text(pages, model).collect()
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        article = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])
    assert len(rows) == len(raw)


def test_layouts_not_seen_in_training(pages, model):
    right = n = 0
    for i, r in enumerate(pages.orderBy("page_id").limit(40).collect()):
        tree = H.parse(r["html"])
        label = H.own_labels(tree)
        blocks = [t for t, s in zip(tree.text, label, strict=True) if t and s == H.INSIDE]
        rest = [t for t, s in zip(tree.text, label, strict=True) if t and s != H.INSIDE]
        for k in range(5):
            new = H.parse(H.relaid(blocks[:12], rest, random.Random(1000 * i + k)))
            for t, s, p in zip(new.text, H.own_labels(new), model.marginals(new), strict=True):
                if t:
                    n += 1
                    right += (s == H.INSIDE) == (p[H.INSIDE] > 0.5)
    assert n > 2000 and right > 0.97 * n


HAND = [
    (
        '<html><body><div id="header"><a href=/>News site</a></div><ul class=menu><li><a href=/a>A</a><li><a href=/b>B</a></ul><div class="main-content"><h1>A title</h1>'
        "<p>The first paragraph of the story has some words in it.<p>The second one follows, with <a href=/x>a link</a> inside.</div>"
        '<div class="sidebar"><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div><div class="site-footer">&copy; 2020 News</div>',
        "A title\nThe first paragraph of the story has some words in it.\nThe second one follows, with a link inside.",
    ),
    (
        '<body><article><h2>Caf&eacute; &lt;b&gt; &#8212; &#x41;</h2><script>if (a<b) "</article>"</script><div>One   two\n three</div><aside>Not this aside text.</aside><p>Four five six seven.</p>'
        '<form><label>Name</label><input><button>Send</button></form><section class="comments"><p>I liked this a lot, thank you for writing it.</p></section></article><footer>Imprint</footer>',
        "Café <b> — A\nOne two three\nFour five six seven.",
    ),
    (
        '<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies to make this site better for you. <button>OK</button></div><main><h1>Head line</h1><div class="ad">Buy this thing now, it is cheap.</div>'
        "<p>Words of the text that stay.</p><ul><li>first point</li><li>second point</li></ul><blockquote>A quoted sentence stays, too.</blockquote></main>",
        "Head line\nWords of the text that stay.\nfirst point\nsecond point\nA quoted sentence stays, too.",
    ),
]


@pytest.mark.parametrize("page, want", HAND)
def test_pages_by_hand(model, page, want):
    assert model.text(page) == want


def leaves(page):
    tree = H.parse(page)
    return [(tree.kind[tree.parent[i]], t) for i, t in enumerate(tree.text) if t is not None]


def test_broken_markup():
    assert leaves("<p>a<p>b</div></p>c<li>d<ul><li>e<li>f</ul>g") == [("p", "a"), ("p", "b"), ("html", "c"), ("li", "d"), ("li", "e"), ("li", "f"), ("li", "g")]
    assert leaves("<table><tr><td>a<td>b<tr><td>c</table>d") == [("td", "a"), ("td", "b"), ("td", "c"), ("html", "d")]
    assert leaves("<dl><dt>a<dd>b<dt>c</dl>") == [("dt", "a"), ("dd", "b"), ("dt", "c")]
    assert leaves("a < b &amp &nosuch; <!-- x --><!-- unclosed <p>y") == [("html", "a < b & &nosuch;")]
    assert leaves("<p title='x>y'>a</p><p title=\"it's\">b</p><p title='open>c") == [("p", "a"), ("p", "b"), ("p", "c")]
    assert leaves("<P>a<B>b</P>c</B><script>x</scripty></script>d<style>") == [("p", "ab"), ("html", "cd")]
    assert leaves("<p>a&nbsp;\t\n b<br>c<wbr>d<hr>e") == [("p", "a b cd"), ("p", "e")]
    assert leaves("<") == [("html", "<")] and leaves("<p") == [] and leaves("") == []


def test_rows_without_text(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a>x</a></nav>"), (3, "u", " \n "), (4, "u", HAND[0][0]), (4, "u", HAND[0][0])]
    got = H.extract_text(spark.createDataFrame([(*r, "x", "y") for r in rows], schema), model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(a, b, HAND[0][1] if a == 4 else "", len(HAND[0][1]) if a == 4 else 0) for a, b, _ in rows], key=repr)
    none = spark.createDataFrame([], schema)
    assert H.extract_text(none, H.fit(H.labelled_sample(none))).collect() == []


def test_long_and_deep_pages(model):
    deep = "<div>" * 20_000 + "x y z." + "</div>" * 20_000
    assert model.text(deep) in ("", "x y z.")
    long = "<article>" + "<p>A sentence of some words stands here.</p>" * 30_000 + "<p>Short</p>" * 3000 + "</article>"
    assert model.text(long).count("\n") == 32_999
    assert model.text("<article><p>" + "word " * 500_000 + "</article>").count(" ") == 499_999


def test_labels_by_marks_are_learnt(spark):
    """Another site's words for its parts, labelled by hand."""
    one = lambda i: f'<div class="zork">Menu {i} of things.</div><div class="blat" data-content="1"><p>Text {i} of things.</p></div>'
    model = H.fit(spark.createDataFrame([(one(i),) for i in range(30)], "html string"))
    assert model.text('<div class="zork"><p>One two.</p></div><div class="blat">Three four.</div>') == "Three four."
