"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks: text between the boundaries that block
elements, rules and the like make, whatever the nesting. Inline elements and line
breaks don't end a block. A block has its number of words and its link density,
those of its neighbours before and after, and what markup says of where it
stands: headings, list items, elements made for articles or for navigation, telling
words in class, id and role of what encloses it, and how much unlinked text its
container has. A decision tree, grown by Gini impurity on the
labelled blocks of ``EXAMPLES``, decides which blocks are text of the article.

Scripts, styles, comments, titles and form controls never are blocks. Character
references are decoded once, after the markup is read; white space inside a block,
of any kind, becomes one space.

Cases: null and empty pages, and pages without article, give an empty text. A
page may end anywhere: an unfinished tag is dropped, open elements close with it. Plain text without
any markup is one block. Very long pages are read whole. Repeated rows give a
result each, rows without identifier too; ties of splits go to the first
feature and the smallest threshold, so the tree is always the same. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bytestext import lean
from .html_examples import EXAMPLES, filled

SLICE_BYTES = 1 << 20
DEPTH = 8
LEAST_LEAF = 3

RAW = "script style template textarea title iframe noframes noembed".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set(
    """html body div section article main nav header footer aside form fieldset ul ol dl li dt dd table tbody thead tfoot tr td th figure details dialog menu
    center button select datalist noscript svg math object canvas audio video""".split()
)
ITEMS, LISTS = ("li", "dt", "dd"), {"ul", "ol", "dl", "menu"}
HEADINGS = {f"h{n}" for n in range(1, 7)}
ARTICLE = {"article", "main"}
AROUND = set("nav header footer aside form fieldset dialog menu button select datalist noscript svg math object canvas audio video".split())
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# Words in class, id and role of what is not the article, and of what is.
AROUND_WORDS = set(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup paywall sidebar side rail aside widget widgets related recommended recommendations
    more share sharing social follow comment comments commentlist disqus respond reply replies responses discussion feedback review reviews menu nav navbar navigation
    breadcrumb breadcrumbs crumbs pagination pager paging footer foot bottom header head masthead top topbar toolbar login signin search form
    copyright legal disclaimer tags tagcloud links toc skip hidden meta byline trending popular""".split()
)
ARTICLE_WORDS = set("article articlebody post entry story content body text main maincontent page prose".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</\1\s*[^>]*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/](?:[^>]*)(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*(?:\Z|(?=<)|>)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    words: int
    linked: int
    text: str
    heading: bool
    item: bool
    article: bool
    around: bool
    hinted: bool
    container: int


@dataclass
class Open:
    """An open element. ``around`` is 1 in a form and 2 in anything else that is not the article; ``number`` is its container's."""

    name: str
    article: bool = False
    around: int = 0
    hinted: bool = False
    number: int = 0
    item: bool = False


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether class, id and role speak of the article, and whether of what is around it.

    A name such as ``comment-body`` speaks of what is around; beside it a name that speaks of the article alone, such as ``content``, decides.
    """
    good = bad = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        for value in "".join(values).split():
            if name.lower() == "role":
                bad |= value.lower() in AROUND_ROLES
                good |= value.lower() in ("main", "article")
                continue
            words = {w.lower() for w in _HINT.findall(value)} | {w for w in re.split("[^a-z]+", value.lower())}
            around = bool(words & AROUND_WORDS)
            bad |= around
            good |= not around and bool(words & ARTICLE_WORDS)
    return good, bad and not good


class _Reader:
    """Cuts one page: the open containers, and the text since the last boundary."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [Open("")]
        self.opened: Counter[str] = Counter()
        self.containers = 0
        self.start("")

    def start(self, name: str, own: Open | None = None) -> None:
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.heading, self.own = name in HEADINGS, own

    def text(self, text: str, link: bool) -> None:
        self.parts.append(text)
        if link:
            self.linked.append(text)

    def end_block(self, name: str = "", own: Open | None = None) -> None:
        words = html.unescape("".join(self.parts)).split()
        if words:
            at = self.own or self.stack[-1]
            linked = len(html.unescape(" ".join(self.linked)).split())
            self.blocks.append(Block(len(words), min(linked, len(words)), " ".join(words), self.heading, at.item, at.article, at.around > 0, at.hinted, at.number))
        self.start(name, own)

    def place(self, name: str, attributes: str) -> Open:
        """Where an element that opens here stands. An article frees its text from a form around the whole page, from nothing else."""
        up = self.stack[-1]
        good, bad = _hints(attributes) if attributes and name not in ("html", "body") else (False, False)
        article = up.article or name in ARTICLE
        around = 0 if name in ARTICLE and up.around == 1 else up.around
        around = max(around, 2 if bad or name in AROUND and name != "form" else int(name == "form"))
        return Open(name, article, around, up.hinted or good, up.number, name in ITEMS or up.item and name not in LISTS)

    def open(self, name: str, attributes: str) -> None:
        if name in ITEMS:  # an item ends the one before it
            for d in range(len(self.stack) - 1, 0, -1):
                if self.stack[d].name in LISTS:
                    break
                if self.stack[d].name in ITEMS:
                    self.cut(d)
                    break
        new = self.place(name, attributes)
        if name not in ITEMS:
            self.containers += 1
            new.number = self.containers
        self.stack.append(new)
        self.opened[name] += 1

    def close(self, name: str) -> None:
        if self.opened[name]:
            self.cut(next(d for d in range(len(self.stack) - 1, 0, -1) if self.stack[d].name == name))

    def cut(self, depth: int) -> None:
        for gone in self.stack[depth:]:
            self.opened[gone.name] -= 1
        del self.stack[depth:]


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    reader, at, link = _Reader(), 0, False
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()], link)
        at = m.end()
        if m[3] is None:
            continue
        name, closing, attributes = m[3].lower(), bool(m[2]), m[4]
        if name == "a":
            link = not closing
        if name == "br":
            reader.text(" ", link)
        if name in INLINE:
            continue
        if name in CONTAINERS:
            reader.end_block()
            if closing:
                reader.close(name)
                link = False
            else:
                reader.open(name, attributes)
        elif closing or name in VOID:
            reader.end_block()
        else:
            reader.end_block(name, reader.place(name, attributes) if attributes else None)
    reader.text(page[at:], link)
    reader.end_block()
    return reader.blocks


FEATURES = (
    "standing", "words", "link density", "words before", "link density before", "words after", "link density after", "heading", "list item", "container's unlinked words",
)


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row per block of all pages, in the order of ``FEATURES``.

    Standing is 0 in what markup says is around an article, 3 in an article; where
    markup says nothing it is 1 if the page has an article elsewhere, else 2.
    """
    blocks = [b for page in pages for b in page]
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    table = np.array([(b.words, b.linked, b.heading, b.item, b.around, b.article or b.hinted, b.container) for b in blocks], float).reshape(-1, 7)
    words, linked, heading, item, around, marked, container = table.T
    density = linked / np.maximum(words, 1)
    _, own = np.unique(np.column_stack([page, container]), axis=0, return_inverse=True)
    together = np.bincount(own.ravel(), words - linked)[own.ravel()] if len(blocks) else words
    first = np.r_[True, page[1:] != page[:-1]][: len(page)]
    last = np.r_[page[1:] != page[:-1], True][: len(page)]

    def moved(x: np.ndarray, by: int, edge: np.ndarray) -> np.ndarray:
        return np.where(edge, 0.0, np.roll(x, by))

    inside = (marked > 0) & (around == 0)
    somewhere = np.bincount(page, inside, len(pages))[page] > 0
    standing = np.where(around > 0, 0, np.where(inside, 3, 2 - somewhere))
    return np.column_stack(
        [standing, words, density, moved(words, 1, first), moved(density, 1, first), moved(words, -1, last), moved(density, -1, last), heading, item, together]
    )


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 in a leaf), threshold, children, share of text in the leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at]
            node = at[inner]
            small = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(small, self.low[node], self.high[node])


def _best_split(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float]:
    """(weighted Gini impurity, feature, threshold) of the best split that leaves enough rows on both sides."""
    best = (np.inf, -1, 0.0)
    n = len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= LEAST_LEAF) & (n - cut >= LEAST_LEAF)]
        if not len(cut):
            continue
        left, p, q = cut, ones[cut - 1], ones[-1] - ones[cut - 1]
        gini = p * (left - p) / left + q * (n - left - q) / (n - left)
        k = int(np.argmin(gini))
        if gini[k] < best[0] - 1e-9:
            best = (float(gini[k]), f, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Tree:
    nodes: list[list] = []

    def node(rows: np.ndarray, left: int) -> int:
        me, ones = len(nodes), int(y[rows].sum())
        nodes.append([-1, 0.0, -1, -1, ones / len(rows)])
        if left and 0 < ones < len(rows):
            _, f, t = _best_split(x[rows], y[rows])
            if f >= 0:
                small = x[rows, f] <= t
                nodes[me][:2] = f, t
                nodes[me][2] = node(rows[small], left - 1)
                nodes[me][3] = node(rows[~small], left - 1)
        return me

    node(np.arange(len(y)), depth)
    f, t, low, high, share = zip(*nodes)
    return Tree(np.array(f), np.array(t), np.array(low), np.array(high), np.array(share))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    xs, ys = [], []
    for page in EXAMPLES:
        for scale in (1, 3, 9):
            parts = filled(page, scale)
            # Pieces are marked by order: blocks are cut from the whole page, labels go by the words of a piece.
            whole = blocks_of("".join(piece for piece, _ in parts))
            kinds = {w: label for piece, label in parts for b in blocks_of(piece) for w in b.text.split()}
            xs.append(features([whole]))
            ys.append([kinds[b.text.split()[0]] for b in whole])
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def trained() -> Tree:
    return grow(*labelled())


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The text of the article of each page, its blocks joined by line feeds."""
    cut = [blocks_of(p or "") for p in pages]
    keep = iter(tree.predict(features(cut)) >= 0.5)
    return ["\n".join([b.text for b in blocks if next(keep)]) for blocks in cut]


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            ends = np.cumsum(pc.binary_length(pages).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(pages):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                texts = main_texts(pages[at:upto].to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, upto - at).columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])
                at = upto

    return lean(run)


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """``keys`` and text: a row per page, read and classified where it is scanned."""
    narrow = pages.select(*[F.col(k) for k in keys], F.col(html_col).cast("string").alias("html"))
    fields = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(_extract(tree or trained()), f"{fields}, text string")
