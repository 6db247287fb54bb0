"""HTML extraction: minimum-cut labelling of text blocks.

A page is scanned into blocks: runs of text between block-level tags, each with
the path of open elements. Blocks with the same path form a node. Every node
gets two costs, for calling it content and for calling it boilerplate, from
tag names, class and id words, link share and length; they are the capacities
to the terminals. Smoothness edges join nodes that follow each other, siblings
(over a marked block between them) and a parent's own text with its children.
Maximum flow (shortest augmenting paths) gives the cut of least cost: nodes left
on the content side are the article.

Text of scripts, styles and the like never becomes a block. The costs are a
linear score with fixed weights, not a fitted one. Elements that HTML marks as
no part of an article cost much as content, names of classes and ids less, so
that long text in an article outweighs a doubtful name. Null and empty pages give an empty text; unclosed, truncated
or stray tags are tolerated; extra columns are ignored; repeated rows are
extracted each.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote opens a value only after "="; elsewhere it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?|[^>=])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
_RAW = frozenset("script style template noscript iframe object svg canvas audio video textarea select datalist title".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A new one of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SELF_CLOSE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_SCOPE = frozenset("html body table td th button article section div main aside nav header footer form".split())

_DROP_TAGS = frozenset("nav footer aside form head button menu dialog".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that name what is seldom part of an article, and those that may also name a part of one.
_BAD = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation navi menu menus submenu topbar toolbar breadcrumb breadcrumbs sidebar footer masthead comment comments reply replies disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login register share sharing recommendations trending widget widgets pagination pager skiplink taglist byline-ads".split()
)
_DOUBTFUL = frozenset("banner aside rail foot respond responses notice notices alert social related recommended copyright legal disclaimer form search searchform skip tags".split())
#: Costs of calling a block content: by what its tag, role or state says, and by its names (a whole name, a part of one).
_MARKED, _NAMED, _DOUBTED = 1000, (400, 250), (90, 50)
_GOOD = frozenset("article post content entry story main body text articlebody maincontent prose markdown page-content blog".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_NOTICE = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog ?in\b", re.I)


def _names(value: str) -> tuple[set[str], set[str]]:
    """The whole names and the words that they are made of."""
    return {re.sub(r"[^a-z]", "", v.lower()) for v in value.split()}, {w.lower() for w in _WORDS.findall(value)}


class _Element:
    """An open element; against: the cost that tags and names put on calling its text content; good: how surely it is the article."""

    __slots__ = ("tag", "parent", "depth", "against", "good", "link")

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.against = parent.against if parent else 0
        self.good = parent.good if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        if tag in _DROP_TAGS or tag == "header" and not self.good:
            self.against = _MARKED
        elif tag in ("article", "main"):
            self.good = max(self.good, 2)
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                whole, parts = _names(value)
                cost = max(c[0] if whole & names else c[1] if parts & names else 0 for names, c in ((_BAD, _NAMED), (_DOUBTFUL, _DOUBTED)))
                # the frame of a page may be named after what it can hold: body class="has-sidebar"
                if cost and tag not in ("html", "body", "article", "main") and not parts & {"with", "has", "no"}:
                    self.against = max(self.against, cost)
                elif (whole | parts) & _GOOD and not cost:
                    self.good = max(self.good, 1)
            elif key == "role":
                if value.lower() in _DROP_ROLES:
                    self.against = _MARKED
                elif value.lower() in ("main", "article"):
                    self.good = max(self.good, 2)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.against = _MARKED
            elif key == "itemprop" and value.lower() == "articlebody":
                self.good = max(self.good, 2)


class Block:
    __slots__ = ("parts", "element", "linked")

    def __init__(self, element: _Element):
        self.parts: list[str] = []
        self.element = element
        self.linked = 0

    def text(self) -> str:
        joined = "".join(self.parts)
        return _SPACE.sub(" ", htmllib.unescape(joined) if "&" in joined else joined).strip()


def scan(page: str) -> list[Block]:
    """Blocks in page order, empty ones included."""
    root = _Element("#root", "", None)
    current, found = root, []
    block: Block | None = None
    at, n = 0, len(page)

    def container(e: _Element) -> _Element:
        while e.tag in _INLINE and e.parent:
            e = e.parent
        return e

    def add(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(container(current))
            found.append(block)
        block.parts.append(text)
        if current.link:
            block.linked += len(text)

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            rest = page[at:]
            add(rest)
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in _INLINE:
                block = None
            e = current
            while e.parent and e.tag != tag and not (tag in _INLINE and e.tag in _SCOPE):
                e = e.parent
            if e.tag == tag and e.parent:
                current = e.parent
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = n if not end else end.start()
            if tag not in ("textarea", "select", "canvas", "svg"):
                block = block if tag in ("script", "style", "template") else None
            close = page.find(">", at) if end else -1
            at = n if close < 0 else close + 1
            continue
        if tag not in _INLINE:
            block = None
        if tag in _VOID or m[3].endswith("/") and tag not in _ENDS_P:
            continue
        if tag in _ENDS_P:
            e = current
            while e.parent and e.tag not in _SCOPE and e.tag != "p":
                e = e.parent
            if e.tag == "p":
                current = e.parent
        elif tag in _SELF_CLOSE:
            names, scope = _SELF_CLOSE[tag]
            e, stop = current, None
            while e.parent and e.tag not in scope:
                if e.tag in names.split():
                    stop = e
                e = e.parent
            if stop:
                current = stop.parent
        current = _Element(tag, m[3], current)
    return found


def costs(element: _Element, chars: int, linked: int, words: int, stops: int, best: int, notice: bool) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content) of one node.

    best is the strongest mark of an article on the page: beside a marked
    article, unmarked text is likelier boilerplate.
    """
    keep, drop = 10, 6 + 40 * (best - element.good) + element.against
    drop += 60 if notice and words < 30 and not element.good else 0
    keep += 40 * element.good
    share = linked / max(chars, 1)
    drop += int(60 * share) if share > 0.5 else 0
    keep += min(60, words) + min(30, 6 * stops)
    e = element
    while e.parent:
        if e.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "figcaption"):
            keep += 15
            break
        if e.tag in ("li", "td", "th", "dt", "dd"):
            break
        e = e.parent
    return keep, drop


def min_cut(keep: list[int], drop: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for nodes on the content side of the cut of least cost.

    keep[i] is the capacity from the content terminal, drop[i] to the other;
    edges are undirected. Shortest augmenting paths, after the flow along
    terminal-node-terminal paths has been sent at once.
    """
    n = len(keep)
    residual: list[dict[int, int]] = [{} for _ in range(n + 2)]
    source, sink = n, n + 1
    for i in range(n):
        sent = min(keep[i], drop[i])
        if keep[i] - sent:
            residual[source][i] = keep[i] - sent
            residual[i][source] = 0
        if drop[i] - sent:
            residual[i][sink] = drop[i] - sent
            residual[sink][i] = 0
    for (i, j), c in edges.items():
        residual[i][j] = residual[i].get(j, 0) + c
        residual[j][i] = residual[j].get(i, 0) + c
    while True:
        came = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in residual[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i in came for i in range(n)]
        flow, j = 1 << 60, sink
        while j != source:
            flow, j = min(flow, residual[came[j]][j]), came[j]
        j = sink
        while j != source:
            i = came[j]
            residual[i][j] -= flow
            residual[j][i] += flow
            j = i


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def label(blocks: list[tuple[Block, str]]) -> list[bool]:
    """Which of the non-empty blocks are content."""
    nodes: list[tuple[_Element, list[int]]] = []
    seen: dict[int, int] = {}
    of = []
    for k, (b, _) in enumerate(blocks):
        e = b.element
        home = e.parent if e.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "td", "th", "tr", "blockquote", "pre") and e.parent and e.against == e.parent.against else e
        key = id(home)
        if key not in seen:
            seen[key] = len(nodes)
            nodes.append((e, []))
        of.append(seen[key])
        nodes[seen[key]][1].append(k)
    keep, drop = [], []
    best = max((e.good for e, _ in nodes if not e.against), default=0)
    for e, members in nodes:
        texts = [blocks[k][1] for k in members]
        joined = sum(map(len, texts))
        kp, dp = costs(e, joined, sum(blocks[k][0].linked for k in members), sum(t.count(" ") + 1 for t in texts), sum(len(re.findall(r"[.!?](?:\s|$)", t)) for t in texts), best, any(_NOTICE.search(t) for t in texts))
        keep.append(kp)
        drop.append(dp)
    edges: dict[tuple[int, int], int] = {}

    def tie(a: int, b: int, capacity: int) -> None:
        if a != b:
            key = min(a, b), max(a, b)
            edges[key] = max(edges.get(key, 0), capacity)

    for a, b in zip(of[:-1], of[1:], strict=True):
        near = _distance(nodes[a][0], nodes[b][0])
        tie(a, b, 12 if near <= 2 else 6 if near <= 4 else 2)
    # siblings and a parent's own text, over whatever marked block stands between them
    last: dict[int, int] = {}
    for k, (e, _) in enumerate(nodes):
        if not e.against:
            for around in (e, e.parent):
                if around is not None and around.parent is not None:
                    if id(around) in last:
                        tie(last[id(around)], k, 8)
                    last[id(around)] = k
    side = min_cut(keep, drop, edges)
    return [side[i] for i in of]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = [(b, t) for b in scan(page) if (t := b.text())]
    if not blocks:
        return ""
    return " ".join(t for (_, t), keep in zip(blocks, label(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    src = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
