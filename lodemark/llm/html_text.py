"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page is parsed into a tree of block elements whose leaves are runs of text
(inline elements belong to their block). Every node has a hidden state: APART
from the content, INSIDE it, or AROUND it, as an element that holds the content
among other things. A potential joins each node's state to its parent's and
depends on the node's kind (its tag and whether it is named, or "text" for a leaf); each node also emits
features: the words of its class, id and role, and for its text the number of
words, the share of words in links and how it ends. Sum-product messages go up
from the leaves to the root and down again, once each, which gives every node's
marginals; leaves more likely inside than not are the main text.

The potentials are counts over labelled pages, smoothed: fit() counts them as a
Spark aggregation, one row a feature and task, and the model that reaches the
driver has a bounded number of features (words met fewer than LEAST times are
dropped, and no page gives more than its nodes). Labelled pages mark content
with data-content="1" and exceptions inside it with data-content="0".
labelled_sample() makes them from at most PAGES pages of at most PAGE_CHARS
characters, those of lowest hash over the whole table, whose own markup shows
the article: its texts in RELAYS other common layouts drawn by rule, and the
page itself as often. The sample trains the model; every page is extracted whole.

Defined results: null or empty html, and a page without content, give an empty
text and 0; broken markup is read as browsers read it (unclosed elements,
stray end tags, unknown references); repeated rows have a row each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PAGES, PAGE_CHARS, RELAYS = 200, 65_536, 6
LEAST, ALPHA = 3, 0.5
APART, INSIDE, AROUND = STATES = range(3)
#: Weight of what a node emits of its text: the features of a leaf, and of the elements above it, say in part the same.
DAMP = 0.3

# How the elements of HTML are read.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template iframe noscript noembed noframes xmp svg math object canvas audio video".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"},
}
#: Where the search for an element to close ends.
SCOPE = set("ul ol dl table select article section aside nav header footer main form body html".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are never part of an article, wherever they stand.
ASIDE = {"nav", "aside", "footer", "form", "head", "button", "select", "dialog", "menu"}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|data-content|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = (".", "!", "?", "…", "”", "\"", ":", "。", "！", "？", "»")


class Tree(NamedTuple):
    """Nodes in page order, a parent before its children; a leaf has a text. link: words of it that stand in links."""

    parent: list[int]
    kind: list[str]
    names: list[tuple[str, ...]]
    text: list[str | None]
    link: list[int]
    mark: list[str]  # the data-content that holds for the node, or ""


def _attributes(raw: str) -> tuple[tuple[str, ...], str]:
    """The words that name an element, and its mark."""
    names, mark = [], ""
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "data-content":
            mark = value
        elif key in ("hidden", "aria-hidden"):
            names += ["hidden"] if value.lower() in ("", "true", "hidden") else []
        elif key == "style":
            names += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        else:
            names += [x.lower() for x in _NAME.findall(value)]
    return tuple(dict.fromkeys(names)), mark


_NAMELESS: tuple[tuple[str, ...], str] = ((), "")


def parse(page: str) -> Tree:
    """The block tree of a page."""
    tree = Tree([-1], ["html"], [()], [None], [0], [""])
    stack, opened = [0], Counter({"html": 1})
    buffer: list[tuple[str, bool]] = []
    links = 0  # open links

    def add(kind: str, names: tuple[str, ...], text: str | None, link: int, mark: str) -> None:
        up = stack[-1]
        tree.parent.append(up)
        tree.kind.append(kind)
        tree.names.append(names)
        tree.text.append(text)
        tree.link.append(link)
        tree.mark.append(mark or tree.mark[up])

    def flush() -> None:
        if buffer:
            words = "".join([x for x, _ in buffer]).split()
            if words:
                linked = sum([len(x.split()) for x, inside in buffer if inside])
                add("text", (), " ".join(words), linked, "")
            buffer.clear()

    def close(to: int) -> None:
        """Pop the stack down to the given length."""
        while len(stack) > to:
            opened[tree.kind[stack.pop()]] -= 1

    def find(tags: set[str], stop: set[str]) -> int:
        """Where the outermost run of tags above the nearest stop begins; 0 if there is none."""
        at = 0
        for i in range(len(stack) - 1, 0, -1):
            kind = tree.kind[stack[i]]
            if kind in tags:
                at = i
            elif kind in stop:
                break
        return at

    def put(text: str) -> None:
        if "&" in text:
            text = references.unescape(text)
        buffer.append((text, links > 0))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue  # a comment or declaration
        tag, ends, raw = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            buffer.append((" ", False))
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else 1
        elif tag in RAW:
            if not ends and not raw.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else n
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag == "html":
            flush()
        elif ends:
            flush()
            links = 0
            if opened[tag] > 0 and tag != "body":
                while tree.kind[stack[-1]] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
        else:
            flush()
            links = 0
            if tag == "body" and opened["body"] > 0:
                continue
            top = tree.kind[stack[-1]]
            if top == "p" or (top in HEADINGS and tag in HEADINGS):
                close(len(stack) - 1)
            if tag in CLOSED_BY and any(opened[x] > 0 for x in CLOSED_BY[tag]):
                to = find(CLOSED_BY[tag], SCOPE - CLOSED_BY[tag])
                if to:
                    close(to)
            names, mark = _attributes(raw) if raw else _NAMELESS
            add(tag, names, None, 0, mark)
            if not raw.endswith("/") or tag in ("p", "div", "li"):
                stack.append(len(tree.parent) - 1)
                opened[tag] += 1
    flush()
    return tree


def own_labels(tree: Tree) -> list[int]:
    """Each node's state: by the marks, or where a page has none by its article or main element."""
    marked, inside, apart = any(tree.mark), [], []
    for i, kind in enumerate(tree.kind):
        up = tree.parent[i]
        apart.append(i > 0 and (apart[up] or kind in ASIDE))
        inside.append(kind in ("article", "main") or (i > 0 and inside[up]))
    main = [(m == "1") if marked else (x and not a) for m, x, a in zip(tree.mark, inside, apart, strict=True)]
    words, holds = [t is not None for t in tree.text], [t is not None and x for t, x in zip(tree.text, main, strict=True)]
    for i in range(len(main) - 1, 0, -1):
        words[tree.parent[i]] |= words[i]
        holds[tree.parent[i]] |= holds[i]
    return [(INSIDE if m else AROUND) if h or (m and not w) else APART for m, h, w in zip(main, holds, words, strict=True)]


def sort_of(tree: Tree, i: int) -> str:
    """What a node's edge depends on: its kind, and whether it is named."""
    return f"{tree.kind[i]}+" if tree.names[i] else tree.kind[i]


def features(tree: Tree) -> list[tuple[str, ...]]:
    """What each node emits besides its names: a leaf its text, an element of several leaves the size and links of their text."""
    n = len(tree.parent)
    words, linked, leaves, out = [0] * n, list(tree.link), [0] * n, [()] * n
    for i in range(n - 1, -1, -1):
        text = tree.text[i]
        if text is not None:
            words[i], leaves[i] = text.count(" ") + 1, 1
        w, share = words[i], (4 * linked[i]) // words[i] if words[i] else 0
        if text is not None:
            out[i] = (f"w{min(6, w.bit_length())}", f"l{min(4, share)}", "e1" if text.endswith(_ENDS) else "e0", "c1" if "©" in text else "c0")
        elif leaves[i] > 1:
            out[i] = (f"W{min(8, w.bit_length())}", f"L{min(4, share)}")
        if i:
            up = tree.parent[i]
            words[up] += w
            linked[up] += linked[i]
            leaves[up] += leaves[i]
    return out


#: Keeps the beliefs of long pages above zero.
_TINY = 1e-200


def _normal(weights: Iterable[float]) -> tuple[float, ...]:
    weights = tuple(weights)
    s = sum(weights)
    return tuple(w / s for w in weights)


class Model:
    """Potentials from counts: (family, value, parent's state or -1, own state) -> n."""

    def __init__(self, counts: dict[tuple[str, str, int, int], int]):
        self.edges: dict[str, tuple[float, ...]] = {}  # by parent's state, then own
        self.emits: dict[str, tuple[float, ...]] = {}
        self.named: dict[str, tuple[float, ...]] = {}
        self._contained: dict[str, tuple[float, ...]] = {}
        edge, emit, name, root = Counter(), Counter(), Counter(), Counter()
        for (family, value, up, own), n in counts.items():
            if family == "edge":
                edge[value, up, own] += n
                edge["", up, own] += n
            elif family == "emit":
                emit[value, own] += n
            elif family == "root":
                root[own] += n
            else:
                name[value, own] += n
        share = lambda n, up, s, prior, weight: (n[up, s] + weight * prior) / (sum(n[up, x] for x in STATES) + weight)
        kinds: dict[str, Counter] = {}
        for (kind, up, own), n in edge.items():
            kinds.setdefault(kind, Counter())[up, own] += n
        prior = {(u, s): share(kinds.get("", Counter()), u, s, 1 / len(STATES), 3 * ALPHA) for u in STATES for s in STATES}
        for kind, n in kinds.items():
            self.edges[kind] = tuple(share(n, u, s, prior[u, s], 1) for u in STATES for s in STATES)
        families = Counter()
        for (value, own), n in emit.items():
            families[value[0], own] += n
        for value in {v for v, _ in emit}:
            self.emits[value] = tuple((emit[value, s] + ALPHA) / (families[value[0], s] + 8 * ALPHA) for s in STATES)
        self.root = tuple((root[s] + ALPHA) / (sum(root.values()) + len(STATES) * ALPHA) for s in STATES)
        total = [sum(n for (_, s), n in name.items() if s == own) for own in STATES]
        known = Counter()
        for (value, _), n in name.items():
            known[value] += n
        for value in (v for v, n in known.items() if n >= LEAST):
            self.named[value] = tuple((name[value, s] + ALPHA) / (total[s] + ALPHA * len(known)) for s in STATES)

    def name(self, word: str) -> tuple[float, ...]:
        """A name's weights; one that was never seen has those of the known names it contains."""
        got = self.named.get(word) or self._contained.get(word)
        if got is None:
            inside = [w for k, w in self.named.items() if len(k) >= 4 and k in word]
            got = _normal(math.prod(w[s] for w in inside) for s in STATES)
            if len(self._contained) < 100_000:
                self._contained[word] = got
        return got

    def own(self, given: tuple[str, ...], names: tuple[str, ...], times: int = 1) -> tuple[float, ...]:
        """What a node's own features say of its state. Nodes of a page that look alike say the same thing again, so each of
        `times` such nodes has a part of the weight, and together they weigh as the logarithm of their number."""
        part, out = DAMP * (1 + math.log(times)) / times, (1.0,) * len(STATES)
        for weights in [*([x**part for x in self.emits[f]] for f in given if f in self.emits), *map(self.name, names)]:
            out = _normal(x * w for x, w in zip(out, weights, strict=True))
        return out

    def marginals(self, tree: Tree) -> list[tuple[float, ...]]:
        """The probabilities of each node's states, by one pass of messages up and one down."""
        n, given = len(tree.parent), features(tree)
        local = {k: self.own(*k, times) for k, times in Counter(zip(given, tree.names, strict=True)).items()}
        belief = [local[k] for k in zip(given, tree.names, strict=True)]
        belief[0] = _normal(x * r for x, r in zip(belief[0], self.root, strict=True))
        other = self.edges.get("", (1.0,) * 9)
        edges = [self.edges.get(sort_of(tree, i), other) for i in range(n)]
        sent = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            t, (x, y, z), up = edges[i], belief[i], tree.parent[i]
            a, b, c = t[0] * x + t[1] * y + t[2] * z, t[3] * x + t[4] * y + t[5] * z, t[6] * x + t[7] * y + t[8] * z
            sent[i] = (a, b, c)
            p, q, r = belief[up]
            a, b, c = a * p, b * q, c * r
            s = a + b + c
            belief[up] = (a / s + _TINY, b / s + _TINY, c / s + _TINY)
        for i in range(1, n):
            t, (x, y, z), (p, q, r), up = edges[i], belief[i], sent[i], belief[tree.parent[i]]
            p, q, r = up[0] / p, up[1] / q, up[2] / r  # the parent's belief without this child's message
            s = p + q + r
            p, q, r = p / s, q / s, r / s
            a, b, c = x * (p * t[0] + q * t[3] + r * t[6]), y * (p * t[1] + q * t[4] + r * t[7]), z * (p * t[2] + q * t[5] + r * t[8])
            s = a + b + c
            belief[i] = (a / s + _TINY, b / s + _TINY, c / s + _TINY)
        return belief

    def text(self, page: str | None) -> str:
        """The main text of a page, a line a block."""
        if not page:
            return ""
        tree = parse(page)
        return "\n".join(t for t, p in zip(tree.text, self.marginals(tree), strict=True) if t is not None and p[INSIDE] > 0.5)


def counts_of(page: str) -> Counter:
    """A labelled page's share of the model's counts."""
    tree = parse(page)
    label, given, out = own_labels(tree), features(tree), Counter()
    out["root", "", -1, label[0]] += 1
    for i, s in enumerate(label):
        if i:
            out["edge", sort_of(tree, i), label[tree.parent[i]], s] += 1
        out.update(("emit", f, -1, s) for f in given[i])
        out.update(("name", w, -1, s) for w in tree.names[i])
    return out


def fit(labelled: DataFrame, html: str = "html") -> Model:
    """Potentials from labelled pages; the result has one entry a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                got.update(counts_of(page or ""))
        keys = list(got)
        columns = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([got[k] for k in keys], pa.int64())], names=["family", "value", "up", "own", "n"])

    rows = labelled.select(html).mapInArrow(run, "family string, value string, up int, own int, n long")
    return Model({(r["family"], r["value"], r["up"], r["own"]): r["n"] for r in rows.groupBy("family", "value", "up", "own").agg(F.sum("n").alias("n")).collect()})


# Names in common use for the parts of a page.
_MAIN = ["article", "main", "section", *(f'div class="{c}"' for c in ("post-content", "entry-content", "article-body", "story", "post", "entry", "content", "article", "main-content", "text", "blog-post", "hentry"))]
_MAIN += ['div id="content"', 'div id="main"', 'div id="article"', 'div role="main"', 'div itemprop="articleBody"', "div", 'td class="content"', 'main id="main-content"', 'article class="post"']
_WRAP = ["", 'div class="container"', 'div id="page"', 'div class="wrapper"', 'div id="main-wrapper"', 'div class="row"', "div", 'div class="content-area"']
_PARTS = {
    "menu": [*["nav"] * 3, *(f'{t} class="{c}"' for t, c in (("ul", "menu"), ("div", "nav"), ("div", "navigation"), ("ul", "navbar"), ("div", "breadcrumb"), ("div", "breadcrumbs"), ("div", "topbar"), ("ol", "pagination"), ("div", "pager"), ("div", "toc"), ("nav", "main-nav"))), 'div id="nav"', 'div id="menu"', 'div role="navigation"'],
    "header": [*["header"] * 3, *(f'div {a}' for a in ('id="header"', 'class="site-header"', 'class="header"', 'class="masthead"', 'class="logo"', 'role="banner"', 'class="branding"')), 'header class="site-header"'],
    "footer": [*["footer"] * 3, *(f'div {a}' for a in ('id="footer"', 'class="site-footer"', 'class="footer"', 'class="copyright"', 'class="legal"', 'class="colophon"', 'role="contentinfo"', 'class="footer-content"')), 'footer class="page-footer"'],
    "side": [*["aside"] * 5, *(f'div {a}' for a in ('id="sidebar"', 'class="sidebar"', 'class="widget"', 'class="related"', 'class="related-posts"', 'class="recent-posts"', 'class="popular"', 'class="trending"', 'class="tags"', 'class="rail"', 'role="complementary"', 'class="sidebar-content"', 'class="recommended"', 'class="see-also"')), 'aside class="sidebar"', 'section class="related-articles"'],
    "notice": ["dialog", *(f'div {a}' for a in ('class="cookie-notice"', 'class="cookie-banner"', 'id="cookies"', 'class="notice"', 'class="consent"', 'class="gdpr"', 'class="alert"', 'class="popup"', 'class="modal"', 'class="newsletter"', 'class="subscribe"', 'class="paywall"', 'class="disclaimer"', 'role="alert"', 'role="dialog"', 'class="overlay"', 'class="warning"', 'class="banner"', "hidden", 'class="message"', 'class="toast"', 'class="privacy"')), 'section class="cookie-consent"'],
    "advert": [f'{t} class="{c}"' for t, c in (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "sponsored"), ("div", "sponsor"), ("div", "promo"), ("div", "promotion"), ("section", "ad-slot"), ("div", "adsense"), ("div", "ad-banner"), ("div", "banner-ad"), ("div", "affiliate"))],
    "form": [*["form"] * 3, *(f'{t} {a}' for t, a in (("form", 'class="search"'), ("form", 'class="login"'), ("div", 'class="search-form"'), ("form", 'id="contact"'), ("div", 'class="signup"'), ("form", 'class="comment-form"'), ("fieldset", 'class="form"')))],
    "comment": [f'{t} {a}' for t, a in (("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="discussion"'), ("div", 'class="replies"'), ("div", 'id="disqus"'), ("section", 'id="responses"'), ("div", 'class="comment"'), ("div", 'class="reviews"'), ("section", 'class="reader-comments"'), ("div", 'class="feedback"'), ("article", 'class="comment"'))],
    "share": [f'div class="{c}"' for c in ("share", "social", "sharing", "share-buttons", "social-links", "print", "tools", "post-meta-links")],
}
_CALLS = "Home;About;Contact us;Sign in;Log in;Subscribe;Search;Share;Read more;More;Next;Previous;Menu;Skip to content;Follow us;Reply;Send;Accept all cookies;Privacy policy;Terms of use".split(";")


def relaid(blocks: list[str], rest: list[str], draw: random.Random) -> str:
    """One labelled page with an article of the given blocks, in a layout drawn by rule; other parts reuse words of both."""
    words = " ".join([*blocks[:20], *rest]).split() or ["word"]

    def some(low: int, high: int) -> str:
        at = draw.randrange(len(words))
        return references.escape(" ".join(words[at : at + draw.randint(low, high)]))

    def wrap(how: str, inside: str, more: str = "") -> str:
        return f"<{how}{more}>{inside}</{how.split()[0]}>" if how else inside

    def link() -> str:
        return f'<a href="/{draw.randrange(99)}">{draw.choice(_CALLS) if draw.random() < 0.5 else some(1, 6)}</a>'

    def part(kind: str) -> str:
        how = draw.choice(_PARTS[kind])
        if kind in ("menu", "side") and draw.random() < 0.8:
            tag = "" if how.startswith(("ul", "ol")) else "ul"
            head = f"<h3>{some(1, 3)}</h3>" if kind == "side" else ""
            inside = head + wrap(tag, "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 8))))
        elif kind == "comment":
            one = lambda: wrap(draw.choice(['div class="comment"', "li", 'article class="comment"', "div", "p"]), f"<p>{some(4, 50)}</p>" + (f"<p>{some(2, 30)}</p>" if draw.random() < 0.4 else ""))
            inside = (f"<h3>{some(1, 3)}</h3>" if draw.random() < 0.7 else "") + "".join(one() for _ in range(draw.randint(1, 5)))
        elif kind == "form":
            inside = f"<p>{some(2, 12)}</p>" * draw.randint(0, 1) + f"<label>{some(1, 3)}</label><input name=q><select><option>{some(1, 2)}<option>{some(1, 2)}</select><button>{draw.choice(_CALLS)}</button>"
        elif kind == "footer":
            inside = draw.choice(["&copy; ", ""]) + some(3, 14) if draw.random() < 0.5 else f"<p>&copy; 2024 {some(2, 8)}</p><ul><li>{link()}</li><li>{link()}</li></ul>"
        elif kind == "header":
            inside = draw.choice([f"<h1>{some(1, 4)}</h1>", f"<p>{some(2, 8)}</p>", some(1, 6)]) + (link() if draw.random() < 0.4 else "")
        elif kind == "share":
            inside = " ".join(link() for _ in range(draw.randint(2, 4)))
        else:
            inside = draw.choice([some(4, 30), f"<p>{some(4, 40)}</p>", f"<p>{some(4, 20)}</p><p>{link()}</p>", f"{some(3, 12)} {link()}", f"<h4>{some(2, 5)}</h4><p>{some(6, 40)}</p>"])
        return wrap(how, inside, ' data-content="0"')

    style = draw.random()
    body = []
    for i, text in enumerate(blocks):
        text = references.escape(text)
        if i == 0 and draw.random() < 0.8:
            head = f"<h1>{text}</h1>"
            body.append(f'<header class="{draw.choice(["entry-header", "article-header", "post-title"])}">{head}</header>' if draw.random() < 0.25 else head)
        elif style < 0.12:
            body.append(wrap("div", text))
        else:
            pick = draw.random()
            shapes = (f"<h2>{text}</h2>", f"<ul><li>{text}</li><li>{some(1, 12)}</li></ul>", f"<blockquote><p>{text}</p></blockquote>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>", f"<table><tr><td>{text}<td>{some(1, 4)}</table>", f"<pre>{text}</pre>", f'<p>{text} <a href="/x">{some(1, 5)}</a> {some(2, 9)}</p>', f'<p class="{draw.choice(["lead", "intro", "paragraph", "text"])}">{text}</p>', f"<section><h2>{some(2, 6)}</h2><p>{text}</p></section>", f"<div><p>{text}</p></div>")
            body.append(shapes[int(pick * 40)] if pick < 0.25 else f"<p>{text}</p>")
    inner = ["advert", "side", "notice", "share", "form", "menu", "comment"]
    for _ in range(draw.choice((0, 0, 1, 1, 2))):
        kind = draw.choice(inner)
        body.insert(len(body) if kind == "comment" else draw.randint(1, len(body)), part(kind))
    bare = style > 0.95  # no element around the article
    main = "\n".join(body) if bare else wrap(draw.choice(_MAIN), "\n".join(body), ' data-content="1"')
    if main.startswith("<td"):
        main = f"<table><tr>{wrap('td', part('menu'))}{main}</tr></table>"
    before = [part(k) for k in ("menu", "header", "notice", "advert", "side", "form") if draw.random() < 0.45]
    after = [part(k) for k in ("comment", "side", "advert", "share", "menu", "notice", "form", "footer") if draw.random() < 0.4]
    draw.shuffle(before)
    draw.shuffle(after)
    inside = "".join([*before, main, *after])
    for _ in range(draw.choice((0, 1, 1, 2))):
        inside = wrap(draw.choice(_WRAP), inside)
    mark = ' data-content="1"' if bare else ""
    return f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title></head><body{mark}>{inside}</body></html>"


def labelled_sample(pages: DataFrame, html: str = "html", most: int = PAGES, chars: int = PAGE_CHARS, relays: int = RELAYS) -> DataFrame:
    """Labelled pages (html) made from at most `most` pages whose markup shows the article; from a page of plain words where none does."""
    small_batches(pages.sparkSession)
    x = F.col(html)
    shown = pages.filter((F.length(x) <= chars) & F.lower(x).rlike(r"<(article|main)[\s>]"))
    chosen = shown.select(x.alias("html")).orderBy(F.xxhash64(x), x).limit(most)
    plain = f"<article>{'<p>one two three four.</p>' * 4}</article><footer>five six</footer>"
    chosen = chosen.unionByName(pages.sparkSession.range(1).select(F.lit(plain).alias("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                tree = parse(page)
                label = own_labels(tree)
                blocks = [t for t, s in zip(tree.text, label, strict=True) if t is not None and s == INSIDE]
                rest = [t for t, s in zip(tree.text, label, strict=True) if t is not None and s != INSIDE]
                draw = random.Random(zlib.crc32(page.encode()))
                made = [*[page] * max(1, relays), *[relaid(blocks[: draw.choice((3, 6, 12, 40))] or ["word"], rest, draw) for _ in range(relays)]]
                yield pa.RecordBatch.from_arrays([pa.array(made)], names=["html"])

    return chosen.repartition(pages.sparkSession.sparkContext.defaultParallelism, "html").mapInArrow(run, "html string")


def extract_text(pages: DataFrame, model: Model, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, the main text, and its number of code points."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(p) for p in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return pages.select(*keep, F.col(html)).mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
