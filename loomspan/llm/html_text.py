"""Main text of web pages by minimum-cut labelling.

A tolerant scan turns the page into blocks, runs of text between block-level tags, and the tree
of elements that hold them. Each block is priced with log odds of being content: what the
elements above it lend (landmarks such as ``article`` or ``nav``, and names of class and id),
and what a classifier reads from its own text (link share, length, signs, notices). They become
its capacity towards the source or the sink. Neighbours in page order are joined by smoothness
edges, strong between blocks of one kind and weak across kinds; elements are nodes too, joined
to their blocks and to their parents, so that blocks near each other in the DOM lean the same
way. The minimum cut is the labelling of least cost; blocks on the source side are the article.
Edges weigh as much as the classifier's odds, so neighbours turn blocks that are in doubt.

The classifier is fitted on a bounded sample of pages whose landmarks serve as labels: blocks
below ``article`` or ``main`` against blocks below ``nav``, ``aside``, ``footer`` and the like.
Tasks count the sample's blocks by their features, and only these counts reach the driver. No
name decides alone: a name counts by the share of its words that are known to mark other things
than the article, and a word it does not know takes most of the weight away.

Labels that no neighbourhood could turn are fixed first (their capacity is at least that of all
their edges together), which leaves the cut as it is; augmenting paths settle the rest.

Rows: a null or empty page has an empty text; ids may be null or repeat; only the three named
columns are read. Text of scripts, styles, embedded objects and hidden elements is none of the
page; an embedded object that is never closed ends with the element that holds it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no markup, up to their end tag or the end of the page.
RAW = frozenset("script style textarea title iframe".split())
_RAW_END = {name: re.compile(rf"(?i)</{name}\b[^>]*>?") for name in RAW}
#: Elements whose content is markup but no text of the page.
EMBEDDED = frozenset("noscript template svg object audio video canvas select datalist".split())
INLINE = EMBEDDED | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends open elements of these kinds, up to one of the second kind.
_LISTS, _TABLES = frozenset(("ul", "ol", "menu")), frozenset(("table",))
_ENDS = {"li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr", "td", "th")), _TABLES), "td": (frozenset(("td", "th")), _TABLES | {"tr"}), "th": (frozenset(("td", "th")), _TABLES | {"tr"}), "option": (frozenset(("option",)), frozenset(("select",)))}
_SCOPE = frozenset("body article section main div nav aside header footer form table td th li ul ol blockquote figure".split())

#: Log odds that landmarks lend to the blocks below them.
TAG_ODDS = {"article": 4.0, "main": 2.5, "nav": -8.0, "aside": -8.0, "footer": -8.0, "header": -8.0, "form": -8.0, "button": -8.0, "dialog": -8.0, "fieldset": -8.0, "address": -3.0, "head": -12.0, "menu": -8.0, "figure": -0.5}
ROLE_ODDS = {"navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0, "dialog": -8.0, "alertdialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "main": 2.5, "article": 4.0, "toolbar": -8.0, "status": -8.0, "note": -5.0}
#: Words in names of class and id: of other things than the article, of such things or parts of
#: it, of the article, and of layout, which say nothing.
SURE = frozenset("ad ads advert adverts advertisement advertising adsense banner comment comments cookie cookies consent gdpr sidebar nav navbar navigation menu share sharing social related recommended promo promoted promotion sponsor sponsored newsletter subscribe subscription signup login breadcrumb breadcrumbs popup modal overlay disqus respond replies pagination pager toolbar masthead copyright".split())
UNSURE = frozenset("header footer notice notices notification alert warning disclaimer widget meta tags tag byline search skip top bottom rail aside teaser toc author bio".split())
GOOD = frozenset("article content post entry story body main text prose".split())
LAYOUT = GOOD | frozenset("page site container wrapper wrap box block inner outer list item items link links section area left right center col column row bar btn button buttons group holder panel unit slot module card title form icon icons feed posts stories articles news user users reader readers visitor media trail google dfp js wp ui view region zone primary secondary global message policy".split())
NAME_ODDS, UNSURE_WEIGHT, GOOD_ODDS = -9.0, 0.9, 1.5
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NOTICE = re.compile(r"(?i)©|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog in\b")
#: What the classifier reads of a block: 1, link share squared, length, signs, heading, notice.
#: The weights that it has before it sees pages; a fit stays within half and twice of them.
PRIOR = (-1.0, -4.0, 1.0, 0.5, 1.0, -2.5)
SAMPLE_PAGES, RIDGE = 2000, 4.0
#: Edges between neighbours of one kind, of one parent, and others; of a block to the element
#: that holds it and its like, and of an element to its parent.
ALIKE, SIBLING, APART, IN_PARENT, TO_PARENT = 1.2, 0.25, 0.1, 0.5, 0.25
UNIT = 1000


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    odds: float  # of everything above and this
    content: bool  # below an article or main
    hidden: bool
    land: int  # the landmark it is in: 1 the article's, -1 another, 0 none
    named: bool  # a name above it or its own lends odds
    kind: str  # tag and attributes, which blocks of one kind share


@dataclass(slots=True)
class Block:
    text: str
    element: int
    linked: int
    heading: bool


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0.0, False, False, 0, False, "")])
    blocks: list[Block] = field(default_factory=list)


def _name_odds(name: str, lenient: bool) -> float:
    """Log odds that one name of class or id lends."""
    words = [w.lower() for w in _TOKEN.findall(name)]
    known = [1.0 if w in SURE else UNSURE_WEIGHT if w in UNSURE and not lenient else 0.0 for w in words if w not in LAYOUT and len(w) > 1]
    if any(known):
        return NAME_ODDS * (sum(known) / len(known)) ** 2
    return GOOD_ODDS if any(w in GOOD for w in words) else 0.0


def _lent(tag: str, attributes: str, inside: bool) -> tuple[float, bool, bool]:
    """(log odds of an element by itself, hidden, whether names are part of the odds)."""
    odds = TAG_ODDS.get(tag, 0.0)
    if tag == "header" and inside:
        odds = 0.0  # the head of the article itself
    if not attributes or tag in ("html", "body", "main"):
        return odds, False, False
    hidden, names = False, []
    lenient = tag in HEADINGS or tag == "article" or inside and tag == "header"
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "itemprop"):
            names += [_name_odds(n, lenient) for n in value.split()]
        elif name == "role":
            odds += ROLE_ODDS.get(value.strip().lower(), 0.0)
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif name == "hidden" or value.lower() == "true":
            hidden = True
    least = min(names, default=0.0)
    lent = least if least < 0 else max(names, default=0.0)
    return odds + lent, hidden, lent != 0


def _total(above: float, own: float) -> float:
    """An article in a sidebar, or a comment in an article, stays mostly what the worse one says."""
    if own > 0 > above:
        return max(-14.0, above + min(2.0, own))
    return max(-14.0, min(6.0, above + own))


def parse(source: str) -> Page:
    page = Page()
    stack = [0]
    run: list[str] = []
    linked = links = muted = 0
    heading = False

    def close_block() -> None:
        nonlocal run, linked, heading
        if run:
            text = " ".join("".join(run).split())
            if text:
                at = stack[-1]
                while page.elements[at].tag in INLINE:
                    at = page.elements[at].parent
                page.blocks.append(Block(text, at, linked, heading))
        run, linked, heading = [], 0, False

    def say(text: str) -> None:
        nonlocal linked, heading
        if text and not muted:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if links:
                linked += len("".join(text.split()))
            heading = heading or any(page.elements[e].tag in HEADINGS for e in stack[-3:])

    def pop(to: int) -> None:
        nonlocal links, muted
        while len(stack) > to:
            tag = page.elements[stack.pop()].tag
            links -= tag == "a"
            muted -= tag in EMBEDDED

    pos, n = 0, len(source)
    while pos < n:
        m = _TAG.search(source, pos)
        if not m:
            say(source[pos:])
            break
        say(source[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "br":
                run.append(" ")
                continue
            at = next((i for i in range(len(stack) - 1, 0, -1) if page.elements[stack[i]].tag == tag), 0)
            if tag not in INLINE:
                if not muted:
                    close_block()
            elif at and any(page.elements[e].tag in _SCOPE for e in stack[at + 1 :]) and not muted:
                continue
            if at:
                unmuted = muted
                pop(at)
                if unmuted and not muted and tag not in INLINE:
                    close_block()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, pos)
            if not attributes.rstrip().endswith("/"):
                pos = end.end() if end else n
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag not in INLINE and not muted:
            close_block()
        if tag in VOID or tag in EMBEDDED and attributes.rstrip().endswith("/"):
            continue
        if tag not in INLINE and not muted:
            kinds, until = _ENDS.get(tag, (frozenset(("p", *HEADINGS)) if tag in HEADINGS else frozenset(("p",)), _SCOPE))
            for i in range(len(stack) - 1, 0, -1):
                name = page.elements[stack[i]].tag
                if name in kinds:
                    pop(i)
                    if tag not in ("tr", "td", "th"):
                        break
                elif name in until:
                    break
        above = page.elements[stack[-1]]
        odds, hidden, named = (0.0, False, False) if tag in INLINE and not attributes else _lent(tag, attributes, above.content)
        land = -1 if above.land < 0 or TAG_ODDS.get(tag, 0.0) <= -8.0 and odds < 0 else 1 if tag in ("article", "main") else above.land
        page.elements.append(Element(tag, stack[-1], _total(above.odds, odds), above.content or tag in ("article", "main"), above.hidden or hidden, land, above.named or named, tag + attributes.strip()))
        stack.append(len(page.elements) - 1)
        links += tag == "a"
        muted += tag in EMBEDDED
    close_block()
    return page


def features(page: Page, b: Block) -> tuple[float, ...]:
    """What the classifier reads, in steps, so that a corpus has few distinct rows of it."""
    letters = len(b.text) - b.text.count(" ")
    words = b.text.count(" ") + 1
    share = round(4 * min(1.0, b.linked / max(1, letters))) / 4
    notice = words < 40 and not page.elements[b.element].content and bool(_NOTICE.search(b.text))
    return 1.0, share**2, round(min(3.0, words / 6) * 4) / 4, float(any(c in b.text for c in ".!?;:,")), float(b.heading), float(notice)


def log_odds(page: Page, b: Block, weights: tuple[float, ...] = PRIOR) -> float:
    """Of a block being content."""
    e = page.elements[b.element]
    return -16.0 if e.hidden else e.odds + sum(w * x for w, x in zip(weights, features(page, b), strict=True))


def fit(cells: list[tuple[int, tuple[float, ...], int]], rounds: int = 30) -> tuple[float, ...]:
    """Weights of (label, features, number of blocks); both labels weigh the same. Without one
    of the labels the prior stands."""
    held = [sum(n for y, _, n in cells if y == label) for label in (0, 1)]
    if not all(held):
        return PRIOR
    x, y = np.array([f for _, f, _ in cells]), np.array([y for y, *_ in cells], float)
    n = np.array([n / held[y] for y, _, n in cells]) * min(500.0, sum(held) / 2)
    prior = np.array(PRIOR)
    low, high = np.minimum(prior / 2, prior * 2), np.maximum(prior / 2, prior * 2)
    w = prior.copy()
    for _ in range(rounds):  # Newton, kept within the bounds
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - RIDGE * (w - prior)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(prior))
        w = np.clip(w + np.clip(np.linalg.solve(hessian, gradient), -1, 1), low, high)
    return tuple(round(float(v), 6) for v in w)


def labelled(source: str | None) -> Iterator[tuple[int, tuple[float, ...]]]:
    """(label, features) of blocks below a landmark, but those that a name speaks for."""
    page = parse(source) if source else Page()
    for b in page.blocks:
        e = page.elements[b.element]
        if e.land and not e.hidden and not e.named:
            yield int(e.land > 0), features(page, b)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """The classifier's weights, from the pages of at most ``most`` ids, chosen by a hash."""
    ids = pages.select(pages[id_col].alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    sample = pages.select(pages[id_col].alias("id"), pages[html_col].cast("string").alias("html")).join(F.broadcast(ids), "id").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for t in batch.slice(lo, 256).column(0).to_pylist():
                    cells.update(labelled(t))
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in cells], pa.int32()), pa.array([list(f) for _, f in cells], pa.list_(pa.float64())), pa.array(list(cells.values()), pa.int64())], names=["y", "f", "n"])

    # the steps of the features bound the rows: 5 * 13 * 2 * 2 * 2 for either label
    counts = sample.mapInArrow(count, "y int, f array<double>, n bigint").groupBy("y", "f").agg(F.sum("n").alias("n"))
    return fit(sorted((r.y, tuple(r.f), r.n) for r in counts.collect()))


def graph(page: Page, weights: tuple[float, ...] = PRIOR) -> tuple[list[int], dict[tuple[int, int], int]]:
    """(capacities of nodes: to the source if positive, to the sink if negative; edges).
    Blocks come first, then the elements that hold two or more of them."""
    n = len(page.blocks)
    capacity = [round(UNIT * log_odds(page, b, weights)) for b in page.blocks]
    edges: dict[tuple[int, int], int] = {}
    for i in range(n - 1):
        a, b = page.elements[page.blocks[i].element], page.elements[page.blocks[i + 1].element]
        sibling = page.blocks[i].element == page.blocks[i + 1].element or a.parent == b.parent
        edges[i, i + 1] = round(UNIT * (ALIKE if sibling and a.kind == b.kind else SIBLING if sibling else APART))
    node: dict[int, int] = {}

    def of(element: int) -> int:
        if element not in node:
            node[element] = len(capacity)
            capacity.append(0)
        return node[element]

    for i, b in enumerate(page.blocks):
        above = page.elements[b.element].parent if page.elements[b.element].parent > 0 else b.element
        edges[i, of(above)] = round(UNIT * IN_PARENT)
    for element in [*node]:
        below, up = element, page.elements[element].parent
        while up > 0:
            known = up in node
            edges[of(below), of(up)] = round(UNIT * TO_PARENT)
            if known:
                break
            below, up = up, page.elements[up].parent
    return capacity, edges


def source_side(capacity: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Nodes on the source side of a minimum cut."""
    n = len(capacity)
    left = list(capacity)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    # nodes that no neighbourhood can turn become part of a terminal
    todo = [*range(n)]
    while todo:
        i = todo.pop()
        if label[i] is None and abs(left[i]) >= sum(near[i].values()):
            label[i] = left[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                left[j] += c if label[i] else -c
                todo.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    while True:  # shortest augmenting paths among the rest
        before: dict[int, int] = {i: -1 for i in open_ if left[i] > 0}
        queue, end = deque(before), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in near[i].items():
                if c > 0 and j not in before:
                    before[j] = i
                    if left[j] < 0:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            break
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        flow = min(-left[end], left[path[-1]], *(near[a][b] for b, a in zip(path, path[1:], strict=False)))
        left[end] += flow
        left[path[-1]] -= flow
        for b, a in zip(path, path[1:], strict=False):
            near[a][b] -= flow
            near[b][a] += flow
    return [before.__contains__(i) if label[i] is None else bool(label[i]) for i in range(n)]


def extract(source: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    side = source_side(*graph(page, weights))
    return " ".join(b.text for b, content in zip(page.blocks, side, strict=False) if content)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """Per page row: id, url, text, n_chars; ``weights`` as :func:`train` finds them."""
    a, b = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    weights = weights or train(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [extract(t, weights) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(pages[id_col], pages[url_col], pages[html_col].cast("string")).mapInArrow(run, f"`{id_col}` {a}, `{url_col}` {b}, text string, n_chars bigint")
