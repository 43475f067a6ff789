"""Main text of web pages: boosted trees over the nodes of the page's tree, then a decoding along the tree.

A tolerant reader builds the tree (missing end tags, comments, raw elements). Each element but inline ones gets features: its tag, the words of
its class and id, the same of the nearest telling ancestors, depth, subtree length, shares of linked text and of punctuation, density of
text over tags, and its place and likeness among siblings. Gradient-boosted trees give it a score of being part of the article.

Decoding chooses a state for every node at once so that the sum of scores, weighted by text, is greatest: outside, inside the article, or
excluded from it. On the way down states only go outside, inside, excluded; so a part of an excluded block is never taken back in, and an
article has no article inside a dropped part. Scripts, styles, forms' controls and the head never give text.

The trees are fitted on at most ``SAMPLE`` pages, those with the smallest hashes of their ids, that mark their article by ``article`` or
``main``. Each also appears rebuilt in ``VARIANTS`` other layouts, whose names and surroundings (menus, notices, side bars, forms, adverts,
comments, made of the page's own words) are drawn by a generator seeded with the page id; so the trees cannot lean on one layout.
All pages are then read whole.

Text: character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank in page order.
A null page is empty; a page without an article gives an empty text. Without any marked page in the sample the made-up layouts of one
short text are used for fitting. Rows and other columns stay; new columns replace those of the same names. An empty table stays empty.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm import boosting
from framekit.llm.common import long_texts, slices

SAMPLE, VARIANTS = 400, 4
# Names that the web uses, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: What a head may hold; any other tag, or text, ends a head that was not closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Where a slash before the end closes a tag of any name.
FOREIGN = frozenset(("svg", "math"))
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+$")
SILENT = frozenset("head title script style template noscript iframe object svg canvas select option button textarea input datalist audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split(),
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre section summary table ul".split(),
)
SIBLINGS_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl body html div section article main aside td th".split())
GOOD_WORDS = frozenset("article content main post entry body story text prose page copy".split())
BAD_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager toolbar tabs skip",
    "head": "header masthead topbar branding logo banner site",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending tags tagcloud archive",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion commercial outbrain taboola",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe signup paywall message",
    "form": "form search login register contact input field",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread feedback reviews",
    "share": "share sharing social follow like buttons actions meta byline author",
}
BAD_OF = {word: group for group, words in BAD_WORDS.items() for word in words.split()}
GROUPS = tuple(BAD_WORDS)
BAD_TAGS = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "menu": "menu", "dialog": "notice"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S,
)
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes are read only where one of these words stands.
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A name word counts as each of these words that it holds, if that has so many letters.
PART_LETTERS = 4


@lru_cache(1 << 16)
def meaning(word: str) -> tuple[int, frozenset[str]]:
    """Whether a word of a class or id speaks of content, and of which surroundings."""
    if word in GOOD_WORDS or word in BAD_OF:
        return int(word in GOOD_WORDS), frozenset([BAD_OF[word]] if word in BAD_OF else [])
    bad = frozenset(group for known, group in BAD_OF.items() if len(known) >= PART_LETTERS and known in word)
    return int(not bad and any(len(known) >= PART_LETTERS and known in word for known in GOOD_WORDS)), bad


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. ``events`` holds (node, text), with None for the border of a block."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    silent: list[bool] = field(default_factory=lambda: [False])
    marked: list[bool] = field(default_factory=lambda: [False])
    events: list[tuple[int, str | None]] = field(default_factory=list)


def is_hidden(rest: str) -> bool:
    """Whether the attributes of a tag hide it: by their names ``hidden`` or ``aria-hidden``, or by the value of ``style``; other values do not count."""
    if not MAY_HIDE.search(rest):
        return False
    found: dict[str, str] = {}
    for name, x, y, z in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), x or y or z)  # of a repeated attribute the first counts
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(found.get("style", "")))


def closes_itself(rest: str) -> bool:
    """Whether a tag ends with a slash that is not part of an unquoted value."""
    return rest.endswith("/") and not UNQUOTED_END.search(rest)


def read_page(source: str) -> Page:
    page, stack, at = Page(), [0], 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if page.tags[node] not in INLINE:
                page.events.append((stack[-1], None))

    def close_open(wanted: tuple[str, ...], scope: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[depth]]
            if tag in wanted:
                close_to(depth)
                return
            if tag in scope:
                return

    while True:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            if page.tags[stack[-1]] == "head" and not text.isspace():
                close_to(len(stack) - 1)
            page.events.append((stack[-1], text))
        if not m:
            break
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tags[stack[depth]] == tag:
                    close_to(depth)
                    break
            continue
        if tag == "body":
            close_open(("head",), frozenset())
        elif tag not in IN_HEAD and page.tags[stack[-1]] == "head":
            close_to(len(stack) - 1)
        if tag in CLOSES_P:
            close_open(("p",), SCOPES)
        if tag in SIBLINGS_CLOSE:
            close_open(SIBLINGS_CLOSE[tag], frozenset(("table", "ul", "ol", "dl")))
        if tag == "br":
            page.events.append((stack[-1], " "))
            continue
        if tag not in INLINE:
            page.events.append((stack[-1], None))
        node = len(page.tags)
        values = " ".join(x or y or z for x, y, z in NAMES.findall(rest)) if rest else ""
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.names.append(tuple(w.lower() for w in WORD.findall(values)))
        page.marked.append(page.marked[stack[-1]] or MARK in rest)
        page.silent.append(page.silent[stack[-1]] or tag in SILENT or bool(rest and is_hidden(rest)))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not (rest and closes_itself(rest) and (tag in FOREIGN or any(page.tags[x] in FOREIGN for x in stack))):
            stack.append(node)
    close_to(1)
    return page


FEATURES = (
    "depth", "share", "chars", "own", "linked", "marks", "density", "paragraphs", "place", "siblings", "alike", "good", "good_above", "is_p", "is_heading", "is_list", "is_box",
    "is_article", "bad", "bad_above", "bad_below", *(f"bad_{g}" for g in GROUPS),
)


def node_features(page: Page) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Nodes that are scored (all but inline and silent ones), their features, and their own text's length (inline children included)."""
    n = len(page.tags)
    block = [i == 0 or page.tags[i] not in INLINE for i in range(n)]
    owner, link = list(range(n)), [False] * n
    for i in range(1, n):
        if not block[i]:
            owner[i] = owner[page.parents[i]]
        link[i] = page.tags[i] == "a" or link[page.parents[i]]
    own, linked, marks, paragraphs, children = (np.zeros(n) for _ in range(5))
    for node, text in page.events:
        if text and not page.silent[node]:
            size = len(text.strip())
            own[owner[node]] += size
            if link[node]:
                linked[owner[node]] += size
            marks[owner[node]] += text.count(",") + text.count(".")
    chars, tags, bad_below = own.copy(), np.ones(n), np.zeros(n)
    told = [[meaning(w) for w in names] for names in page.names]
    bad = [{g for _, groups in told[i] for g in groups} | ({BAD_TAGS[page.tags[i]]} if page.tags[i] in BAD_TAGS else set()) for i in range(n)]
    good = [sum(x for x, _ in told[i]) + 2 * (page.tags[i] in ("article", "main")) for i in range(n)]
    place = np.zeros(n)
    alike: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        if block[i]:
            place[i] = children[page.parents[i]]
            children[page.parents[i]] += 1
            alike[page.parents[i], page.tags[i]] = alike.get((page.parents[i], page.tags[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
        bad_below[p] += bad_below[i] + chars[i] * bool(bad[i])
        paragraphs[p] += paragraphs[i] + (page.tags[i] == "p")
    depth, bad_above, good_above = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = page.parents[i]
        depth[i] = depth[p] + block[i]
        bad_above[i] = bad_above[p] + len(bad[p])
        good_above[i] = good_above[p] + good[p]
    scored = [i for i in range(n) if block[i] and not page.silent[i]]
    rows = []
    for i in scored:
        tag, p = page.tags[i], page.parents[i]
        siblings = children[p] if i else 1
        rows.append((
            depth[i], chars[i] / (chars[0] + 1), np.log1p(chars[i]), np.log1p(own[i]), linked[i] / (chars[i] + 1), marks[i] / (chars[i] + 1), chars[i] / tags[i], np.log1p(paragraphs[i]),
            place[i] / max(1, siblings), siblings, alike.get((p, tag), 1) / max(1, siblings), good[i], good_above[i], tag == "p",
            len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag in ("ul", "ol", "li", "dl", "dt", "dd"), tag in ("div", "section", "td"),
            tag in ("article", "main"), len(bad[i]), bad_above[i], bad_below[i] / (chars[i] + 1), *(g in bad[i] for g in GROUPS),
        ))
    return scored, np.array(rows, float).reshape(len(scored), len(FEATURES)), own[scored]


OUTSIDE, INSIDE, EXCLUDED = 0, 1, 2
#: What a way from outside to inside costs, so that a page has few regions and no stray words.
ENTER = 16.0


def decode(page: Page, scored: list[int], logits: np.ndarray, own: np.ndarray) -> list[bool]:
    """For each node, whether its own text belongs to the article: the best states along the tree."""
    n = len(page.tags)
    gain = np.zeros(n)  # inline nodes follow the node that holds them
    gain[scored] = np.clip(logits, -6, 6) * (0.5 + np.log1p(own))
    best = np.zeros((n, 3))
    best[:, OUTSIDE], best[:, INSIDE], best[:, EXCLUDED] = -gain, gain, -gain
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        best[p, OUTSIDE] += max(best[i, OUTSIDE], best[i, INSIDE] - ENTER)
        best[p, INSIDE] += max(best[i, INSIDE], best[i, EXCLUDED])
        best[p, EXCLUDED] += best[i, EXCLUDED]
    state = [OUTSIDE] * n
    block = set(scored)
    for i in range(1, n):
        above = state[page.parents[i]]
        if i not in block:
            state[i] = above
        elif above == OUTSIDE:
            state[i] = INSIDE if best[i, INSIDE] - ENTER > best[i, OUTSIDE] else OUTSIDE
        elif above == INSIDE:
            state[i] = EXCLUDED if best[i, EXCLUDED] > best[i, INSIDE] else INSIDE
        else:
            state[i] = EXCLUDED
    return [s == INSIDE for s in state]


def page_text(page: Page, inside: list[bool]) -> str:
    blocks: list[str] = []
    parts: list[str] = []
    for node, text in page.events:
        if text is None:
            if parts:
                blocks.append(" ".join(html.unescape("".join(parts)).split()))
                parts = []
        elif inside[node] and not page.silent[node]:
            parts.append(text)
    blocks.append(" ".join(html.unescape("".join(parts)).split()))
    return " ".join(b for b in blocks if b)


def article_text(source: str, model: boosting.Boosted) -> str:
    page = read_page(source)
    scored, x, own = node_features(page)
    return page_text(page, decode(page, scored, model.logits(x), own))


# training pages

#: An attribute that tells a made-up page's article; only labels are read from it.
MARK = "data-truth"

ARTICLES = (
    "<article>", "<main>", '<div class="content">', '<div id="main-content">', '<section class="post-body">', '<div class="entry-content">', '<div class="story text">',
    "<div>", '<div class="x1">', "<section>", "<table><tr><td>", '<div><div class="blog-post">', '<div id="bodyContent">', '<main><article class="post">', '<div id="content"><div class="article-body">', '<div class="wrapper"><div class="page-content">',
)


def _end(start: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))


def layout(paragraphs: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page made of the given paragraphs and, for each of its text blocks in order, whether it belongs to the article."""
    fragment = rng.random() < 0.25
    out: list[str] = [] if fragment else ["<html><head><title>t</title></head><body>"]
    if rng.random() < 0.4:  # short texts
        paragraphs = [" ".join(p.split()[: rng.randint(3, 14)]) for p in paragraphs[: rng.randint(1, 8)]]
    truth: list[bool] = []
    words = " ".join(paragraphs).split() or ["word"]

    def some(low: int, high: int) -> str:
        k = rng.randrange(len(words))
        return " ".join((words[k:] + words)[: rng.randint(low, high)])

    def put(tag: str, text: str, keep: bool) -> None:
        out.append(f"<{tag}>{text}</{tag.split()[0]}>")
        truth.append(keep)

    def links(n: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            put("li", f'<a href="/x">{some(1, 5)}</a>', False)
        out.append("</ul>")

    def within(starts: tuple[str, ...], fill) -> None:
        start = rng.choice(starts)
        out.append(start)
        fill()
        out.append(_end(start))

    def prose(low: int = 1, high: int = 3, size: int = 40) -> None:
        for _ in range(rng.randint(low, high)):
            put(rng.choice(("p", "p", "div")), some(3, size), False)

    def comments() -> None:
        put("h3", some(1, 4), False)
        for _ in range(rng.randint(1, 5)):
            out.append(rng.choice(('<div class="comment">', "<li>", '<div class="reader-comment">', "<div>")))
            put("p", some(5, 80), False)
            out.append("</div>" if out[-2].startswith("<div") else "</li>")

    def controls() -> None:
        put("p", some(1, 8), False)
        out.append('<input name="q"><button>go</button>')

    before = [
        lambda: within(("<nav>", '<div class="menu">', '<div id="navbar">', '<header><nav>', '<ul class="nav-list"><li>'), lambda: links(rng.randint(2, 9))),
        lambda: within(("<header>", '<div class="site-header">', '<div id="masthead">'), lambda: put(rng.choice(("h1", "div", "p")), some(1, 8), False)),
        lambda: within(('<div class="cookie-notice">', '<div id="consent-banner">', '<div class="alert notice">', '<div role="alert">', "<dialog>"), prose),
        lambda: within(('<div class="ad">', '<div class="advert">', '<aside class="sponsored">', '<div id="ad-banner">', '<section class="promo">'), prose),
        lambda: within(("<form>", '<form class="search">', '<div class="newsletter-form"><form>'), controls),
        lambda: within(("<div>", '<div id="top-bar">', '<ul class="mainmenu"><li>', '<div class="c1">'), lambda: links(rng.randint(1, 7))),
        lambda: within(('<div class="breadcrumb">', '<nav class="breadcrumbs">'), lambda: put("p", f'<a href="/">{some(1, 3)}</a>', False)),
    ]
    after = [
        lambda: within(("<aside>", '<div class="sidebar">', '<div id="side-rail">', '<div class="widget">', '<aside class="related">'), lambda: (put("h3", some(1, 4), False), links(rng.randint(1, 6)) if rng.random() < 0.5 else prose())),
        lambda: within(('<section class="comments">', '<div id="comments">', '<div class="discussion">', '<ol class="commentlist">', '<section id="respond">'), comments),
        lambda: within(('<div class="share-buttons">', '<div class="social">', '<p class="tags">'), lambda: put("p", f'<a href="/t">{some(1, 3)}</a>', False)),
        lambda: within(('<div id="ft">', "<div>", '<div class="bottom">'), lambda: put("p", "&copy; " + some(1, 6), False)),
        before[2], before[3], before[4],
    ]
    foot = lambda: within(("<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer"><p>'), lambda: put(rng.choice(("p", "div")), "&copy; " + some(2, 30), False))
    page_box = "".join(rng.choice(("<div>", '<div id="page">', '<div class="container">', '<div class="row">', '<div class="col-8">', "<table><tr><td>")) for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))))
    out.append(page_box)
    for make in rng.sample(before, rng.randint(1, 5)):
        make()
    if rng.random() < 0.3:
        after[0]()
    start = rng.choice(ARTICLES)
    out.append(start.replace(">", f" {MARK}>", 1))
    if rng.random() < 0.8:
        put(rng.choice(("h1", "h1", "h2")), some(3, 14), True)
    own = paragraphs if rng.random() < 0.8 else paragraphs[: rng.randint(1, 2)]
    inner = rng.random()
    for k, paragraph in enumerate(own):
        if rng.random() < 0.08:
            put("h2", some(1, 8), True)
        if rng.random() < 0.05:
            out.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                put("li", some(3, 20), True)
            out.append("</ul>")
        if rng.random() < 0.04:
            out.append("<figure>")
            put("figcaption", some(1, 9), True)
            out.append("</figure>")
        if rng.random() < 0.04:
            out.append("<table><tr>")
            for _ in range(rng.randint(1, 4)):
                put("td", some(1, 6), True)
            out.append("</tr></table>")
        if rng.random() < 0.05:
            out.append("<blockquote>")
            put("p", some(3, 30), True)
            out.append("</blockquote>")
        put("p", paragraph, True)
        if inner < 0.35 and (k == len(own) // 2):
            rng.choice((before[3], before[2], before[4], after[0], after[1], after[2]))()
    if inner > 0.8:
        rng.choice((after[0], after[1], foot))()
    out.append(_end(start))
    for make in rng.sample(after, rng.randint(0, 4)):
        make()
    if rng.random() < 0.9:
        foot()
    out.append(_end(page_box) if page_box else "")
    return "".join(out) + ("" if fragment else "</body></html>"), truth


def labelled(source: str, truth: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a layout's nodes: a node belongs if it is the article or a part of it most of whose text belongs."""
    page = read_page(source)
    scored, x, own = node_features(page)
    order = iter(truth)
    good, total = np.zeros(len(page.tags)), np.zeros(len(page.tags))
    rank = {node: i for i, node in enumerate(scored)}
    for node in scored:
        if own[rank[node]] > 0:
            total[node] = own[rank[node]]
            good[node] = total[node] * next(order, False)
    for i in range(len(page.tags) - 1, 0, -1):
        total[page.parents[i]] += total[i]
        good[page.parents[i]] += good[i]
    held = [i for i in scored if total[i] > 0]
    inside = [rank[i] for i in held]
    return x[inside], np.array([page.marked[i] and 2 * good[i] >= total[i] for i in held], float)


def marked_paragraphs(source: str) -> list[str] | None:
    """Blocks of the page's only marked article, escaped, or None."""
    page = read_page(source)
    marked = [i for i, t in enumerate(page.tags) if t in ("article", "main")]
    if not marked:
        return None
    inside = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        inside[i] = i == marked[0] or inside[page.parents[i]]
    blocks: list[str] = []
    parts: list[str] = []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(joined)
            parts = []
        elif inside[node] and not page.silent[node]:
            parts.append(text.replace("<", "&lt;"))
    return blocks or None


def training_rows(page_id: int, source: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one marked page: as it is, and in other layouts."""
    paragraphs = marked_paragraphs(source)
    if paragraphs is None:
        return
    page = read_page(source)
    inside = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        inside[i] = page.tags[i] in ("article", "main") or inside[page.parents[i]]
    scored, x, _ = node_features(page)
    yield x, np.array([inside[i] for i in scored], float)
    for k in range(VARIANTS):
        yield labelled(*layout(paragraphs, random.Random(page_id * VARIANTS + k)))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> boosting.Boosted:
    ids = pages.select(F.col(id_col).alias("id")).distinct().withColumn("hash", F.xxhash64("id")).orderBy("hash", "id").limit(sample)
    chosen = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids.select("id")), "id")  # at most ``sample`` rows

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for n, (_, source) in enumerate(sorted(zip(pdf["id"], pdf["html"], strict=True), key=str)) for r in training_rows(n, source or "")]
        if not rows:
            rows = [labelled(*layout(["A first block of plain words, with marks. It goes on."] * 5, random.Random(k))) for k in range(400)]
        model = boosting.fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))
        return pd.DataFrame({"feature": list(model.feature), "limit": list(model.limit), "value": list(model.value), "start": model.start})

    # the sample is bounded, so one task may hold it
    shape = "feature array<bigint>, limit array<double>, value array<double>, start double"
    trees = chosen.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(train, shape).collect()
    if not trees:
        return boosting.fit(np.empty((0, len(FEATURES))), np.empty(0))
    return boosting.Boosted(np.array([t.feature for t in trees]), np.array([t.limit for t in trees]), np.array([t.value for t in trees]), trees[0].start)


def extract(pages: DataFrame, model: boosting.Boosted | None = None, id_col: str = "page_id", html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the article's text."""
    model = model or fit(pages, id_col, html_col)
    kept = [f for f in pages.schema.fields if f.name.lower() != out.lower()]
    at = [f.name for f in pages.schema.fields].index(html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = [read_page(source or "") for source in batch.column(at).to_pylist()]
            parts = [node_features(page) for page in read]
            logits = model.logits(np.concatenate([x for _, x, _ in parts]))
            ends = np.cumsum([len(s) for s, _, _ in parts])[:-1]
            texts = [page_text(p, decode(p, s, z, own)) for p, (s, _, own), z in zip(read, parts, np.split(logits, ends), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), out])

    return long_texts(pages).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
