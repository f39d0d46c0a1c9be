"""HTML extraction by minimum cut.

A page is read into blocks of text with their place in the document tree. Two
logistic regressions (``html_model``) give costs: a block's from its own text,
links and element, a part's (any container: body, article, nav, div ...) from
its tag, names, contents and place. Blocks and parts are the nodes of a graph,
their costs the capacities to the two terminals. A block is joined to its part,
a part to the one around it and neighbouring blocks to each other by smoothness
edges. The maximum flow separates content from boilerplate: a short line in an
article stays for its article's sake, a long comment goes with its section.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements by their standing in HTML.
_RAW = frozenset("script style textarea title iframe template xmp noembed noframes svg select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option html body".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("datalist",)}
#: Block elements that hold one text rather than a part of the page.
_LEAF = frozenset("p li dt dd td th tr tbody thead tfoot caption figcaption summary option pre h1 h2 h3 h4 h5 h6 hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements open at once at most, as browsers have it; deeper ones count as the text of the last.
DEEPEST = 512


class Element:
    """An open element: its tag, what its names say, and whether its text is linked or hidden."""

    __slots__ = ("tag", "parent", "names", "link", "hidden", "n")

    def __init__(self, tag: str, parent: Element | None, names: tuple[str, ...] = (), hidden: bool = False):
        self.tag, self.parent, self.names = tag, parent, names
        self.link = tag == "a" or parent is not None and parent.link
        self.hidden = hidden or parent is not None and parent.hidden
        self.n = -1

    @property
    def part(self) -> Element:
        """The nearest element that is a part of the page."""
        e = self
        while e.parent is not None and (e.tag not in _BLOCK or e.tag in _LEAF):
            e = e.parent
        return e


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The words of class, id, role and itemprop, and whether the element is hidden."""
    found, hidden = [], False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDES.search(value):
            hidden = True
        elif key in ("class", "id", "role", "itemprop"):
            words = [w.lower() for w in _NAME.findall(value)]
            found += [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in words]
    return tuple(dict.fromkeys(found)), hidden


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order; unclosed and stray tags are read as browsers do."""
    out: list[Block] = []
    root = Element("", None)
    stack = [root]
    now = Block(root)
    at = 0

    def text(piece: str) -> None:
        if not piece:
            return
        top = stack[-1]
        if top.hidden:
            return
        piece = unescape(piece) if "&" in piece else piece
        now.parts.append(piece)
        if top.link:
            now.linked += len(piece.strip())

    def end() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        top = stack[-1]
        while top.parent is not None and top.tag not in _BLOCK:
            top = top.parent
        now = Block(top)

    def close(k: int) -> None:
        if any(e.tag in _BLOCK for e in stack[k:]):
            end_before = stack[:k]
            del stack[k:]
            assert end_before
            end()
        else:
            del stack[k:]

    while True:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "p" or tag == "br":
                end() if tag == "p" else text(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK:
                    break
            continue
        if tag in _RAW or tag == "head":
            if tag == "svg" and attributes.endswith("/"):
                continue
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(html, at)
            at = stop.end() if stop else (at if tag == "head" else len(html))
            if tag in ("button", "select", "textarea"):
                text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                end()
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    close(k)
                    break
                if stack[k].tag in _SCOPES[tag]:
                    break
        if len(stack) < DEEPEST:
            stack.append(Element(tag, stack[-1], *(_names(attributes) if attributes else ())))
        if tag in _BLOCK:
            end()
    end()
    return out


# --- the classifier -------------------------------------------------------------------------------


def _step(x: float, edges: tuple[float, ...]) -> int:
    """How many of the edges x has reached."""
    return sum(x >= e for e in edges)


def block_features(block: Block) -> list[str]:
    """What a block shows by itself: its text, its links and its own element, not the part of the page it lies in."""
    text, words = block.text, block.text.count(" ") + 1
    long, linked = _step(words, (2, 4, 8, 16, 40)), _step(block.linked / len(text), (0.01, 0.3, 0.8))
    out = ["", f"words {long}", f"linked {linked}", f"words {long} linked {linked}"]
    out.append("ends " + ("sentence" if text[-1] in ".!?…:”\"" else "open"))
    if _RIGHTS.search(text):
        out.append("rights")
    if sum(c.isdigit() for c in text[:200]) > 0.3 * min(200, len(text)):
        out.append("digits")
    e = block.parent
    out.append(f"is {'heading' if e.tag in _HEADINGS else e.tag if e.tag in _LEAF and e.tag != 'p' else 'text'}")
    while e.parent is not None and (e.tag in _LEAF or e.tag not in _BLOCK):
        out += [f"named {n}" for n in e.names]
        e = e.parent
    return out


@dataclass
class Part:
    """A part of the page, with sums over the blocks in it."""

    element: Element
    parent: int
    blocks: int = 0
    words: int = 0
    chars: int = 0
    linked: int = 0
    sentences: int = 0
    first: int = 0


def parts_of(blocks: list[Block]) -> tuple[list[Part], list[int]]:
    """The parts that hold text, outer ones first, and the part of each block."""
    parts: list[Part] = []
    place: list[int] = []
    number: dict[int, int] = {}

    def known(e: Element) -> int:
        chain = []
        while id(e) not in number:
            chain.append(e)
            if e.parent is None:
                break
            e = e.parent.part
        for e in reversed(chain):
            number[id(e)] = len(parts)
            parts.append(Part(e, -1 if e.parent is None else number[id(e.parent.part)], first=len(place)))
        return number[id(e)]

    for b in blocks:
        home = b.parent.part
        known(home)
        k = number[id(home)]
        place.append(k)
        p = parts[k]
        p.blocks += 1
        p.words += b.text.count(" ") + 1
        p.chars += len(b.text)
        p.linked += b.linked
        p.sentences += b.text[-1] in ".!?…"
    for p in reversed(parts):
        if p.parent >= 0:
            q = parts[p.parent]
            q.blocks += p.blocks
            q.words += p.words
            q.chars += p.chars
            q.linked += p.linked
            q.sentences += p.sentences
    return parts, place


def part_features(parts: list[Part], k: int) -> list[str]:
    """What a part of the page shows: its tag and names, what it holds and where, and what holds it."""
    p, page = parts[k], parts[0]
    share = _step(p.words / page.words, (0.1, 0.5, 0.8))
    out = ["", f"share {share}", f"tag {p.element.tag}", f"tag {p.element.tag} {share}"]
    for n in p.element.names:
        out += [f"name {n}", f"name {n} {share}"]
    linked, mean = _step(p.linked / p.chars, (0.01, 0.1, 0.3, 0.6, 0.9)), _step(p.words / p.blocks, (2, 4, 8, 16, 32))
    out += [f"linked {linked}", f"mean {mean}", f"linked {linked} mean {mean}"]
    out.append(f"sentences {_step(p.sentences / p.blocks, (0.1, 0.4, 0.7, 0.9))}")
    out.append(f"from {_step(p.first / page.blocks, (0.001, 0.3, 0.7))} to {_step((p.first + p.blocks) / page.blocks, (0.3, 0.7, 0.999))}")
    up, k = 0, p.parent
    while k > 0 and up < 12:
        e, big = parts[k].element, _step(parts[k].words / page.words, (0.5,))
        out += [f"in {e.tag} {big}", *(f"in name {n} {big}" for n in e.names)]
        up, k = up + 1, parts[k].parent
    return out


_RIGHTS = re.compile(r"©|\(c\) \d{4}|all rights reserved", re.I)


@dataclass
class Model:
    """Weights (log-odds of content) of the features of blocks and of parts."""

    block: dict[str, float]
    part: dict[str, float]


# --- the cut ----------------------------------------------------------------------------------------

#: Smoothness edges: a block and its part, a part and the one around it, neighbours in one part and in two.
HOLD, NEST, NEAR, FAR = 3.0, 0.5, 0.2, 0.05


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node stays with the source: blocking flows along shortest paths."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forth)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(source, i, c, 0.0)
        elif c < 0:
            join(i, sink, -c, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [v >= 0 for v in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(left[e] for e in path)
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if left[e] <= tiny)
                node = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[node] < len(out[node]):
                e = out[node][place[node]]
                if left[e] > tiny and level[to[e]] == level[node] + 1:
                    break
                place[node] += 1
            if place[node] < len(out[node]):
                path.append(e)
                node = to[e]
            elif path:
                node = to[path.pop() ^ 1]
                place[node] += 1
            else:
                break


def costs_of(model: Model, blocks: list[Block]) -> tuple[list[float], list[float], list[Part], list[int]]:
    """Log-odds of content of each block and of each part; the parts, and the part of each block.

    A part speaks for all the blocks it holds at once and their texts say much the
    same: its cost grows with the root of their number, the texts' share shrinks with it.
    """
    parts, place = parts_of(blocks)
    one, two = model.block, model.part
    held = Counter(place)
    around = [sum(two.get(f, 0.0) for f in part_features(parts, k)) * max(1, held[k]) ** 0.5 for k in range(len(parts))]
    own = [sum(one.get(f, 0.0) if f.startswith("named") else one.get(f, 0.0) / held[k] ** 0.5 for f in block_features(b)) for b, k in zip(blocks, place)]
    return own, around, parts, place


def label(model: Model, blocks: list[Block]) -> list[bool]:
    """For each block whether it is content: blocks and parts of the page are nodes of one graph, cut where it is cheapest."""
    if not blocks:
        return []
    own, around, parts, place = costs_of(model, blocks)
    n = len(own)
    edges = [(i, n + k, HOLD) for i, k in enumerate(place)]
    edges += [(n + k, n + p.parent, NEST) for k, p in enumerate(parts) if p.parent >= 0]
    edges += [(i - 1, i, NEAR if place[i - 1] == place[i] else FAR) for i in range(1, n)]
    return min_cut(own + around, edges)[:n]


def main_text(html: str | None, model: Model | None = None) -> str:
    """The page's content: blocks in page order, joined by a line feed."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, good in zip(blocks, label(model or trained(), blocks)) if good)


def trained() -> Model:
    from .html_model import train

    return train()


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text and n_chars (code points).

    A null, empty or text-free page gives an empty text and 0. Pages are read
    whole and one by one, so rows that repeat get equal texts, and a page
    nested deeper than DEEPEST keeps its text. An empty table gives no rows.
    Only the three columns are read, so further columns cannot clash.
    """
    model = model or trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.block, model.part))  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = [main_text(h.as_py(), model) for h in batch.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))],
                    names=["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
