"""Main text of web pages by a tree-structured graphical model on the DOM.

Every block element of a page is a node with two states, content or not. A node's own evidence
is a sum of learned weights: its tag, the words of its class, id and role, how much text it holds
itself and beneath it, and how much of that is links. A learned potential on each parent-child pair carries
evidence along the tree. Messages go from the leaves to the root and back (sum-product), which
gives the exact marginal of each node; text whose node is content with probability one half or
more is kept. Weights and potentials maximise the likelihood of labelled pages, whose gradient
needs just these marginals.

All pages of a slice are solved together: nodes are numpy arrays, messages go depth by depth.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import let_go, sliced
from .html_pages import labelled_pages

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are no block: their text belongs to the block around them.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("head title script style template noscript svg iframe object select option textarea button canvas audio video math".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: A start tag that closes an open element of these tags, looked for up to the bounding tags.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Nodes below this depth hang on the one at it, as in browsers; text is not affected.
DEEPEST = 512
_BOUNDS = frozenset("ul ol dl table article section div td th body html".split())

CLASS_BUCKETS = 1024
TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset button select label other".split()
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
TEXT_STEPS = (1, 20, 60, 150, 400)
LINK_STEPS = (0.2, 0.5, 0.9)
BENEATH_STEPS = (1, 100, 300, 1000, 3000)
_TEXT_AT = len(TAGS) + CLASS_BUCKETS
_LINK_AT = _TEXT_AT + len(TEXT_STEPS) + 1
_BENEATH_AT = _LINK_AT + len(LINK_STEPS) + 1
_BENEATH_LINK_AT = _BENEATH_AT + len(BENEATH_STEPS) + 1
N_FEATURES = _BENEATH_LINK_AT + len(LINK_STEPS) + 2


class Forest:
    """The block nodes of several pages, parents before children, and the text of each."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.attributes: list[str] = []
        self.own: list[int] = []
        self.linked: list[int] = []
        self.page_of: list[int] = []
        #: (page, node, text) in page order; node -1 is a space between blocks
        self.runs: list[tuple[int, int, str]] = []
        self.pages = 0

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        if parent >= 0 and self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.own.append(0)
        self.linked.append(0)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Parse a page as leniently as browsers do, as far as blocks and text go."""
        number, self.pages = self.pages, self.pages + 1
        root = self._node(-1, "html", "")
        stack = [("html", root)]  # open elements; inline ones with the node of their block
        silent = links = 0
        at, runs = 0, self.runs
        length, last = len(page), page.rfind(">") + 1
        # places in the stack: of each tag, of blocks, of tags that bound what a start tag closes
        where: dict[str, list[int]] = {}
        blocks, bounds = [0], [0]

        def close(depth: int) -> None:
            nonlocal silent, links
            while len(stack) > depth:
                tag, _ = stack.pop()
                silent -= tag in SILENT
                links -= tag == "a"
                if stack:
                    where[tag].pop()
                    if tag not in INLINE:
                        blocks.pop()
                    if tag in _BOUNDS:
                        bounds.pop()
                if tag not in INLINE:
                    runs.append((number, -1, " "))

        def latest(*tags: str) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        def text(a: int, b: int) -> None:
            if a < b and not silent:
                t = page[a:b]
                if "&" in t:
                    t = html.unescape(t)
                node = stack[-1][1]
                n = len(t.strip())
                self.own[node] += n
                if links:
                    self.linked[node] += n
                runs.append((number, node, t))

        while at < length:
            m = _TAG.search(page, at, last) if at < last else None
            if m is None:
                comment = page.find("<!--", at)
                text(at, comment if comment >= 0 else length)
                break
            text(at, m.start())
            at = m.end()
            if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                break  # an unclosed comment goes on to the end
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                k = latest(tag)
                if k and (tag not in INLINE or k > blocks[-1]):
                    close(k)
                elif tag == "p":
                    runs.append((number, -1, " "))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    runs.append((number, -1, " "))
                continue
            if tag == "html":
                self.attributes[root] = self.attributes[root] or m[3] or m[6] or ""
                continue
            if tag in ENDS_P or tag in CLOSES:
                wanted = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
                k = latest(*wanted)
                if k and k >= bounds[-1]:
                    close(k)
            where.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            if tag in _BOUNDS:
                bounds.append(len(stack))
            if tag in INLINE:
                stack.append((tag, stack[-1][1]))
            else:
                runs.append((number, -1, " "))
                stack.append((tag, self._node(stack[-1][1], tag, m[3] or m[6] or "")))
            silent += tag in SILENT
            links += tag == "a"
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = end.start() if end else length
        close(0)

    def features(self) -> list[list[int]]:
        """Numbers of the features that each node has from its tag and attributes."""
        known: dict[tuple[str, str], list[int]] = {}
        out = []
        for key in zip(self.tag, self.attributes):
            if key not in known:
                words = {w for name, value in _ATTRIBUTE.findall(key[1]) if name.lower() != "data-main" for w in _WORD.findall(value.lower())}
                known[key] = [_TAG_NUMBER.get(key[0], _TAG_NUMBER["other"]), *(len(TAGS) + zlib.crc32(w.encode()) % CLASS_BUCKETS for w in sorted(words)), N_FEATURES - 1]
            out.append(known[key])
        return out

    def measured(self) -> tuple[np.ndarray, ...]:
        """Numbers of the text-size and link-share features of each node, of its own text and of all beneath it."""
        own, linked = np.array(self.own, np.float64), np.array(self.linked, np.float64)
        parent, depth = np.array(self.parent, np.int64), np.array(self.depth, np.int64)
        beneath = np.stack([own, linked])
        order = np.argsort(-depth, kind="stable")
        for level in np.split(order, np.cumsum(np.bincount(depth)[::-1])[:-1]):
            inner = level[parent[level] >= 0]
            for sums in beneath:
                np.add.at(sums, parent[inner], sums[inner])
        share = lambda part, all_: np.searchsorted(LINK_STEPS, part / np.maximum(all_, 1), side="right")
        return (
            _TEXT_AT + np.searchsorted(TEXT_STEPS, own, side="right"), _LINK_AT + share(linked, own),
            _BENEATH_AT + np.searchsorted(BENEATH_STEPS, beneath[0], side="right"), _BENEATH_LINK_AT + share(beneath[1], beneath[0]),
        )


class Tree:
    """Sum-product on a forest: all messages of one depth at a time."""

    def __init__(self, forest: Forest):
        self.parent, depth = np.array(forest.parent, np.int64), np.array(forest.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(order) else []

    def solve(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (n, 2) of the nodes and (n, 2, 2) of (parent, node) pairs; zero for roots."""
        up, sent = unary.copy(), np.zeros_like(unary)
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp.reduce(up[level][:, None, :] + pair[None], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        full, edge = up.copy(), np.zeros((len(unary), 2, 2))
        for level in self.levels[1:]:
            above = full[self.parent[level]] - sent[level]
            full[level] = up[level] + np.logaddexp.reduce(above[:, :, None] + pair[None], axis=1)
            joint = above[:, :, None] + pair[None] + up[level][:, None, :]
            edge[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        return np.exp(full - np.logaddexp(full[:, 0], full[:, 1])[:, None]), edge


@dataclass
class Model:
    """weights: evidence of each feature for content; pair: log potentials [parent state, child state]."""

    weights: np.ndarray
    pair: np.ndarray

    def content(self, forest: Forest) -> np.ndarray:
        """Probability of each node to be content."""
        if not forest.parent:
            return np.zeros(0)
        known: dict[int, float] = {}
        base = np.array([known.setdefault(id(f), float(self.weights[f].sum())) for f in forest.features()])
        unary = np.stack([np.zeros(len(base)), base + sum(self.weights[f] for f in forest.measured())], axis=1)
        return Tree(forest).solve(unary, self.pair)[0][:, 1]

    def extract(self, pages: list[str]) -> list[str]:
        forest = Forest()
        for p in pages:
            forest.add(p)
        keep = (self.content(forest) >= 0.5).tolist()
        parts: list[list[str]] = [[] for _ in pages]
        for page, node, text in forest.runs:
            if node < 0 or keep[node]:
                parts[page].append(text)
            else:
                parts[page].append(" ")
        return [" ".join("".join(x).split()) for x in parts]


def fit(pages: list[str] | None = None, steps: int = 90, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Maximum likelihood of labelled pages (default: the layouts of this package), by Adam with exact gradients."""
    forest = Forest()
    for p in pages if pages is not None else labelled_pages():
        forest.add(p)
    label = np.zeros(len(forest.parent), np.int64)
    for i, (parent, attributes) in enumerate(zip(forest.parent, forest.attributes)):
        mark = [v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes) if k.lower() == "data-main"]
        label[i] = int(mark[0]) if mark else label[parent] if parent >= 0 else 0
    x = np.zeros((len(label), N_FEATURES))
    for i, f in enumerate(forest.features()):
        x[i, f] = 1
    for f in forest.measured():
        x[np.arange(len(label)), f] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = np.ascontiguousarray(x[:, used])
    tree, weights, pair = Tree(forest), np.zeros(len(used)), np.zeros((2, 2))
    inner = np.array(forest.parent) >= 0
    seen = np.bincount(label[np.array(forest.parent)[inner]] * 2 + label[inner], minlength=4).reshape(2, 2)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, pair)]
    n = max(forest.pages, 1)
    for step in range(1, steps + 1):
        marginal, edge = tree.solve(np.stack([np.zeros(len(label)), x @ weights], axis=1), pair)
        grads = (x.T @ (label - marginal[:, 1]) / n - decay * weights, (seen - edge.sum(axis=0)) / n - decay * pair)
        for value, g, (m, v) in zip((weights, pair), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros(N_FEATURES)
    whole[used] = weights
    return Model(whole, pair)


def extract_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: the main text of the whole html of every row.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one space. Null and empty html, and pages without main text, give ''.
    Rows that repeat, and null ids, are each answered; other columns are not read; an empty
    table gives no rows. Without ``model``, one is trained on this package's labelled pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch, texts in sliced(batches, "html"):
            found = shared.value.extract(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long")
