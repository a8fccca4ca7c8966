"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags, each with its path of open elements. A linear
classifier on a block's own features (the kind of the elements around it, names in their class and id, links,
length, punctuation) gives a cost for labelling it content and one for labelling it boilerplate; these are the
capacities from and to the terminals of a flow network. Edges between neighbouring blocks, and between blocks with the
same parent or grandparent element, carry the price of labelling the two differently. A maximum flow gives the
minimum cut, and the blocks on the source's side are the main text. Names and kinds of elements are features
among others, so that the cut can overrule them; only what is in script, style and the like never becomes a block.

Weights and prices are fitted together, by logistic regression over a bounded sample of the pages themselves, whose weak labels come
from the elements and names that some blocks have; each is taught with these features and without, so that texts,
links and neighbours weigh as well, and pages without telling names are labelled by them.

Inside a block references are decoded and white space becomes one space; blocks are joined by a line feed.

Defined cases: a null or empty page has the text ''; markup that is never closed ends where its parent, or the page,
does; what is in script, style, template, head and comments is never text; repeated rows are answered each; extra
columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Elements that end a block where they begin or end.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
SILENT = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea option".split())
#: Elements that seldom hold the main text.
CHROME = frozenset("nav footer header aside form menu dialog button label fieldset".split())
#: Elements that an opening tag of the same kind ends.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
#: Elements beyond which a start tag closes nothing.
BOUNDS = frozenset("ul ol dl table div section article blockquote main td li nav aside footer header form body".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*\Z", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BAD = re.compile(r"(?:^|[\W_])(?:nav(?:bar|igation)?|menu|foot(?:er)?|head(?:er)?bar|site-?header|masthead|side-?bar|aside|breadcrumbs?|ad|ads|adv|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|comments?|replies|reply|disqus|respond|pagination|pager|widget|toolbar|copyright|legal|disclaimer|hidden|contentinfo|complementary|navigation)(?:$|[\W_])", re.I)
_GOOD = re.compile(r"(?:^|[\W_])(?:article\w*|content|main|body|post|entry|story|text|prose)(?:$|[\W_])", re.I)
_SENTENCE = re.compile(r"[.!?;:,](?:\s|$)")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: What a classifier is pulled towards where few pages teach it: log-odds of main text, as a sum of weights times features.
PRIOR = {
    "bias": -0.5,
    "chrome": -5.0,  # an element around it that holds navigation, forms, headers or footers
    "bad_name": -5.0,  # a class, id or role around it that names such a thing, or a hidden element
    "container": 1.5,  # an article or main element around it, or one named like that
    "outside": -1.0,  # the page has such a container, but not around it
    "length": 1.5,  # characters, in full from LONG on
    "sentences": 1.0,  # punctuation that ends or parts sentences, in full from SENTENCES on
    "linked": -2.5,  # share of its characters inside links
    "paragraph": 0.5,
    "item": -0.5,
    "depth": -0.5,  # open elements, in full from DEEP on
    "copyright": -2.0,
    "with_text": 1.0,  # characters in the same parent, in full from MUCH on
    "with_links": -1.0,  # share of these characters inside links
}
#: What half of the lessons leave out: names, and kinds of elements.
HIDDEN = ("chrome", "bad_name", "container", "outside", "paragraph", "item")
LONG, SENTENCES, DEEP, MUCH = 200, 3, 20, 1000
#: Kinds of edges, with the prices they are pulled towards: neighbours in the page, children of one element, and of one grandparent.
KINDS = {"neighbours": 0.4, "siblings": 0.6, "cousins": 0.3}
#: The pull, in blocks' worth of evidence, and bounds on the sample that teaches: pages, and blocks of each.
PULL = 40.0
#: The largest price of an edge.
MOST = 1.5
MAX_PAGES, MAX_BLOCKS = 1000, 200


class Model(NamedTuple):
    """Weights of the features and prices of the kinds of edges, on one scale (log-odds)."""

    weights: dict[str, float] = PRIOR
    prices: dict[str, float] = KINDS


class Block:
    """A run of text: its parent and grandparent element, and what is around it."""

    __slots__ = ("around", "linked", "size", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, around: Around):
        self.text, self.linked, self.tag, self.around = text, linked, tag, around
        self.size = len(text)


class Around(NamedTuple):
    """What the open elements say of what is in them."""

    parent: int = 0
    up: int = 0
    depth: int = 0
    container: bool = False
    chrome: bool = False
    bad_name: bool = False

    def within(self, number: int, tag: str, side: int) -> Around:
        """Inside one more element. side: -1, 0 or 1 for one that is or is named like chrome, neither, or a container."""
        if tag not in BLOCKS and not side:
            return self
        own_header = tag == "header" and self.container  # an article's own header holds its title
        chrome = side < 0 and tag in CHROME
        return Around(number, self.parent, self.depth + 1, self.container or side > 0, self.chrome or chrome and not own_header, self.bad_name or side < 0 and not chrome)


class _Open:
    """The open elements, with where each kind is open, so that none is searched for."""

    def __init__(self):
        self.stack: list[tuple[str, Around]] = [("", Around())]
        self.where: dict[str, list[int]] = {}
        self.blocks, self.bounds = [0], [0]
        self.silent = 0

    def push(self, tag: str, around: Around) -> None:
        at = len(self.stack)
        self.stack.append((tag, around))
        self.where.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if tag in BOUNDS:
            self.bounds.append(at)
        self.silent += tag in SILENT

    def cut(self, at: int) -> None:
        """Closes the element at a place of the stack, and all in it."""
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.where[tag].pop()
            for held in (self.blocks, self.bounds):
                if held[-1] == len(self.stack):
                    held.pop()
            self.silent -= tag in SILENT

    def last(self, *tags: str) -> int:
        """The place of the innermost of these elements, or 0."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag closes the innermost such element; one that isn't a block's doesn't close blocks."""
        at = self.last(tag)
        if at and (tag in BLOCKS or at > self.blocks[-1]):
            self.cut(at)

    def begin(self, tag: str) -> None:
        """What the start of a block closes."""
        if tag not in ("body", "html"):
            at = self.last(*CLOSES.get(tag, "p").split())
            if at and at >= self.bounds[-1]:
                self.cut(at)


def blocks(html: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    out: list[Block] = []
    now = _Open()
    text: list[str] = []
    linked = link = number = 0
    at, end = 0, len(html)

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, linked, now.stack[now.blocks[-1]][0], now.stack[-1][1]))
            text.clear()
            linked = 0

    while at < end:
        m = _TOKEN.search(html, at)
        upto = m.start() if m else end
        if upto > at and not now.silent:
            text.append(html[at:upto])
            if link:
                linked += upto - at
        if not m:
            break
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag in BLOCKS:
                flush()
            elif tag == "a":
                link = 0
            now.end(tag)
            continue
        if tag in BLOCKS:
            flush()
            now.begin(tag)
        elif tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        elif tag == "a":
            link = 1
        attrs = m.group(3) or ""
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in _RAW_END:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        number += 1
        side = named = -1 if tag in CHROME else 1 if tag in ("article", "main") else 0
        if attrs and side >= 0:
            names = " ".join(n.strip("\"'") for n in _NAMES.findall(attrs))
            if _HIDDEN.search(attrs) or names and tag not in ("body", "html", "article", "main") and _BAD.search(names):
                named = -1
            elif names and tag not in ("body", "html") and _GOOD.search(names):
                named = 1
        now.push(tag, now.stack[-1][1].within(number, tag, named))
    flush()
    return out


def features(found: list[Block]) -> list[dict[str, float]]:
    """The features of each block of a page."""
    article = any(b.around.container for b in found)
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in found:
        size[b.around.parent] = size.get(b.around.parent, 0) + b.size
        linked[b.around.parent] = linked.get(b.around.parent, 0) + min(b.linked, b.size)
    return [
        {
            "bias": 1.0,
            "chrome": float(b.around.chrome),
            "bad_name": float(b.around.bad_name),
            "container": float(b.around.container),
            "outside": float(article and not b.around.container),
            "length": min(1.0, b.size / LONG),
            "sentences": sum(1 for _ in islice(_SENTENCE.finditer(b.text), SENTENCES)) / SENTENCES,
            "linked": min(1.0, b.linked / max(1, b.size)),
            "paragraph": float(b.tag in ("p", "pre", "blockquote", "h1", "h2", "h3")),
            "item": float(b.tag in ("li", "td")),
            "depth": min(1.0, b.around.depth / DEEP),
            "copyright": float(bool(_COPYRIGHT.match(b.text))),
            "with_text": min(1.0, size[b.around.parent] / MUCH),
            "with_links": linked[b.around.parent] / max(1, size[b.around.parent]),
        }
        for b in found
    ]


def log_odds(found: list[Block], model: Model = Model()) -> list[float]:
    """The classifier's verdict on each block by itself."""
    return [sum(model.weights[k] * v for k, v in f.items()) for f in features(found)]


def pairs(found: list[Block]) -> list[tuple[int, int, str]]:
    """The edges between blocks, with their kinds: two for blocks that are near in two ways."""
    out = []
    last: dict[int, int] = {}
    for v, b in enumerate(found):
        if v:
            out.append((v - 1, v, "neighbours"))
        for key, kind in ((b.around.parent, "siblings"), (-1 - b.around.up, "cousins")):
            if key in last:
                out.append((last[key], v, kind))
            last[key] = v
    return out


def smoothness(found: list[Block], model: Model = Model()) -> dict[tuple[int, int], float]:
    """The edges between blocks and their prices."""
    edges: dict[tuple[int, int], float] = {}
    for u, v, kind in pairs(found):
        edges[u, v] = edges.get((u, v), 0.0) + model.prices[kind]
    return edges


def weak_label(block: Block) -> int:
    """1 for what an article or main element (or one named so) holds, -1 for what is in elements or names of boilerplate, 0 where the page doesn't tell."""
    around = block.around
    return -1 if around.chrome or around.bad_name else 1 if around.container else 0


def lessons(html: str) -> list[tuple[float, list[float]]]:
    """(weak label, features and edges) of labelled blocks of a page, MAX_BLOCKS at most, evenly spread: each with its names and kinds of elements, and without.

    An edge's feature is the sum of the weak labels at its other ends: under the cut's prices the log-odds of a block, given its neighbours, are its own plus price
    times that sum (pseudo-likelihood), so that one regression weighs features and edges against each other. Without names and kinds, texts have to tell.
    """
    found = blocks(html)
    label = [weak_label(b) for b in found]
    beside = {kind: [0.0] * len(found) for kind in KINDS}
    for u, v, kind in pairs(found):
        beside[kind][u] += label[v]
        beside[kind][v] += label[u]
    told = [v for v, y in enumerate(label) if y]
    step = max(1, -(-len(told) // MAX_BLOCKS))
    known, out = features(found), []
    for v in told[::step]:
        for hidden in (False, True):
            x = [0.0 if hidden and k in HIDDEN else known[v][k] for k in PRIOR]
            out.append((float(label[v] > 0), x + [beside[kind][v] for kind in KINDS]))
    return out


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float, given: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of the most likely labels y, pulled towards prior; given: log-odds that are known already."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + given, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(taught: list[tuple[float, list[float]]], pull: float = PULL, most: float = MOST) -> Model:
    """Logistic regression, pulled towards PRIOR and KINDS. Prices are kept from 0 to most, so that no neighbourhood outweighs strong evidence, and the weights fitted again with them."""
    if not taught:
        return Model(dict(PRIOR), dict(KINDS))
    y, x = np.array([t[0] for t in taught]), np.array([t[1] for t in taught])
    prior, n = np.array([*PRIOR.values(), *KINDS.values()]), len(PRIOR)
    price = np.clip(_newton(x, y, prior, pull)[n:], 0.0, most)
    w = _newton(x[:, :n], y, prior[:n], pull, x[:, n:] @ price)
    return Model(dict(zip(PRIOR, w.tolist())), dict(zip(KINDS, price.tolist())))


def minimum_cut(n: int, source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each vertex is on the source's side of a minimum cut."""
    flow = _Flow(n + 2)
    for v, (a, b) in enumerate(zip(source, sink)):
        flow.edge(n, v, max(a - b, 0.0), 0.0)
        flow.edge(v, n + 1, max(b - a, 0.0), 0.0)
    for (u, v), w in edges.items():
        flow.edge(u, v, w, w)
    reached = flow.reach(n, n + 1)
    return [level >= 0 for level in reached[:n]]


class _Flow:
    """Maximum flow by blocking flows of the shortest paths (Dinic)."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, w in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(w)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = [s]
        for v in queue:
            for e in self.out[v]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def reach(self, s: int, t: int) -> list[int]:
        """The levels of the vertices that s still reaches (-1: none) once the flow is at its maximum."""
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    least = min(self.room[e] for e in path)
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-9)
                    v = self.to[path[k] ^ 1]
                    del path[k:]
                while at[v] < len(self.out[v]):
                    e = self.out[v][at[v]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                        break
                    at[v] += 1
                else:
                    if not path:
                        break
                    v = self.to[path.pop() ^ 1]
                    at[v] += 1
                    continue
                path.append(e)
                v = self.to[e]
        return level


def labelled(html: str, model: Model = Model()) -> list[tuple[Block, float, bool]]:
    """(block, the classifier's log-odds for content, the cut's label) of a page, in order."""
    found = blocks(html)
    odds = log_odds(found, model)
    side = minimum_cut(len(found), [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], smoothness(found, model))
    return list(zip(found, odds, side))


def main_text(html: str | None, model: Model = Model()) -> str:
    return "\n".join(b.text for b, _, content in labelled(html or "", model) if content)


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """The model fitted to a sample of about max_pages pages, by a hash of their html."""
    n = pages.where("html IS NOT NULL").count()
    share = min(1.0, max_pages / max(n, 1))
    chosen = pages.where(F.pmod(F.xxhash64("html", "url"), F.lit(1_000_000)) < int(1_000_000 * share)).where("html IS NOT NULL")

    def run(batches):
        for batch in batches:
            taught = [t for h in batch.column("html") for t in lessons(h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in taught], pa.float64()), pa.array([t[1] for t in taught], pa.list_(pa.float64()))], ["y", "x"])

    found = in_batches(chosen.select("html")).mapInArrow(run, "y double, x array<double>").toPandas()
    return fit(sorted(zip(found["y"].tolist(), map(list, found["x"]))))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars, n_blocks, n_relabelled): the cut's labels differ from the classifier's own in n_relabelled blocks. Without a model, one is fitted to the pages."""
    model = model or train(pages)

    def run(batches):
        for batch in batches:
            found = [labelled(h.as_py() or "", model) for h in batch.column("html")]
            text = ["\n".join(b.text for b, _, content in page if content) for page in found]
            counts = [[len(t) for t in text], [len(page) for page in found], [sum((odds > 0) != content for _, odds, content in page) for page in found]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], ["page_id", "url", "text", "n_chars", "n_blocks", "n_relabelled"])

    return in_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_relabelled long")
