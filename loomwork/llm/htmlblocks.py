"""Main text of web pages from flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks.  Each has the count of its words, the
share of them inside links, both of its neighbours, and where it stands.  A decision
tree, grown from the small labelled table below, tells article text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they mean for text blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
_SILENT = frozenset("script style template title textarea iframe noscript noframes svg canvas audio video map datalist".split())
_FRAME = frozenset("nav footer aside form fieldset button select dialog menu header search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the value, if one is open inside the nearest of the others.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, {"body"}),
}
# Words in class and id names, and roles, that mark a part of the frame around an article.
_FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion sidebar sidenav rail menu menus nav navbar navigation "
    "breadcrumb breadcrumbs masthead topbar header footer cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies "
    "disqus discussion pagination pager toolbar widget widgets skip copyright tags hidden".split()
)
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words that only say what shape a part of the frame has.
_SHAPE_WORDS = frozenset(
    "area bar block body box button buttons col column container content count desktop first fixed form global group heading icon icons id inner inline "
    "item items js label last left link links list main mobile more outer page panel post posts article articles primary right row secondary section site "
    "slot small sticky sub text thread title top bottom unit web website wp wrap wrapper".split()
)
_ARTICLE_WORDS = frozenset("article articlebody post entry story".split())
_COMMENT_WORDS = frozenset("comment comments reply replies".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: A line of rights at a page's end.
_RIGHTS = re.compile(r"(?i)(?:©|\(c\)|copyright)\s.*\d{4}|.*\ball rights reserved\W*\Z")
_RIGHTS_WORDS = 30
_LINE_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    """A run of text between two breaks."""

    text: str
    words: int
    linked: int
    inside: bool
    frame: bool
    heading: bool


@dataclass
class _Open:
    name: str
    inside: bool
    frame: bool
    link: bool
    heading: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _named_frame(names: str, inside: bool) -> bool:
    """Whether class or id names mark a part of the frame.

    A name must say nothing else, so that "related-posts" and "site-header" do and
    "has-sidebar", "related-work" or "share-price" don't.
    """
    for name in names.split():
        words = {w.lower() for w in _TOKEN.findall(name)}
        if words & _FRAME_WORDS - ({"header"} if inside else set()) and words <= _FRAME_WORDS | _SHAPE_WORDS:
            return True
    return False


def _named_article(names: str) -> bool:
    """Whether a class or id name says that the article stands there, and nothing else."""
    for name in names.split():
        words = {w.lower() for w in _TOKEN.findall(name)}
        if words & _ARTICLE_WORDS and words <= _ARTICLE_WORDS | _SHAPE_WORDS:
            return True
    return False


def _opened(name: str, attributes: str, parent: _Open) -> _Open:
    inside, frame = parent.inside or name in ("article", "main"), parent.frame
    if name in _FRAME and not (name == "header" and parent.inside):
        frame = True
    if attributes and not attributes.isspace():
        found = _attributes(attributes)
        marks = {w.lower() for w in _TOKEN.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        role = found.get("role", "").lower()
        if name in ("article", "main", "body", "html"):
            frame = frame or bool(marks & _COMMENT_WORDS) and name == "article"
        else:
            frame = frame or role in _FRAME_ROLES or _named_frame(f"{found.get('class', '')} {found.get('id', '')}", parent.inside)
            inside = inside or role == "main" or _named_article(f"{found.get('class', '')} {found.get('id', '')}") or found.get("itemprop", "").lower() == "articlebody"
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _LINE_HIDDEN.search(found.get("style", "")):
            frame = True
    return _Open(name, inside, frame, parent.link or name == "a", parent.heading or name in _HEADINGS)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, with character references decoded and white space as single spaces."""
    out: list[Block] = []
    stack = [_Open("", False, False, False, False)]
    is_open: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    where, said = stack[0], False

    def close(k: int) -> None:
        """Ends the elements from the k-th on."""
        is_open.subtract(x.name for x in stack[k:])
        del stack[k:]

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, link in parts if link)
                out.append(Block(text, len(text.split()), linked, where.inside, where.frame, where.heading))
            parts.clear()

    def say(text: str) -> None:
        nonlocal where, said
        if text:
            if not parts:
                where, said = stack[-1], False
            if not said and not text.isspace():
                where, said = stack[-1], True
            parts.append((html.unescape(text) if "&" in text else text, stack[-1].link))

    at = 0
    while True:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        tag = _MARKUP.match(page, begin)
        if not tag:
            say(page[at : begin + 1])
            at = begin + 1
            continue
        say(page[at:begin])
        at = tag.end()
        if not tag[1]:
            continue
        name = tag[1].lower()
        if page[begin + 1] == "/":
            if name in _BREAKS:
                flush()
            if is_open[name] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name in _SILENT:
            if name == "title":
                flush()
            if not tag[2].endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            say(" ")
            continue
        if name in _BREAKS:
            flush()
            if any(x.name == "p" for x in stack[-3:]) and name not in ("option", "optgroup"):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == "p"))  # a block ends an open paragraph
        if name in _IMPLIED and any(is_open[x] > 0 for x in _IMPLIED[name][0]):
            ends, within = _IMPLIED[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in ends:
                    close(k)
                    break
        if name not in _VOID:
            stack.append(_opened(name, tag[2], stack[-1]))
            is_open[name] += 1
    flush()
    return out


#: Neighbours of the labelled blocks: words and link density of the block before and of the one after.
AROUND = [
    (0, 0.00, 60, 0.00), (60, 0.00, 0, 0.00), (60, 0.00, 45, 0.10), (0, 0.00, 0, 0.00), (8, 0.00, 9, 0.00), (2, 0.00, 3, 0.00),
    (3, 1.00, 60, 0.00), (60, 0.00, 4, 1.00), (2, 1.00, 3, 1.00), (0, 0.00, 2, 1.00), (3, 1.00, 0, 0.00), (12, 0.80, 7, 0.90),
]
#: words, link density, place (2: inside the article, 1: the page marks none, 0: outside it), frame, heading, and
#: for each of AROUND whether such a block there is article text.
LABELLED = [
    (1, 0.00, 2, 0, 0, "111111111111"), (4, 0.00, 2, 0, 0, "111111111111"), (9, 0.00, 2, 0, 1, "111111111111"), (2, 0.00, 2, 0, 1, "111111111111"),
    (18, 0.45, 2, 0, 0, "111111111111"), (64, 0.20, 2, 0, 0, "111111111111"), (320, 0.00, 2, 0, 0, "111111111111"), (3, 1.00, 2, 0, 0, "111111111111"),
    (8, 0.50, 2, 0, 0, "111111111111"), (30, 1.00, 2, 0, 0, "111111111111"), (5, 1.00, 2, 0, 1, "111111111111"),
    (3, 1.00, 2, 1, 0, "000000000000"), (30, 0.10, 2, 1, 0, "000000000000"), (140, 0.00, 2, 1, 0, "000000000000"), (5, 0.00, 2, 1, 1, "000000000000"),
    (1, 1.00, 0, 1, 0, "000000000000"), (15, 0.00, 0, 1, 0, "000000000000"), (120, 0.05, 0, 1, 0, "000000000000"), (3, 0.00, 0, 1, 1, "000000000000"),
    (2, 0.00, 0, 0, 0, "000000000000"), (20, 0.00, 0, 0, 0, "000000000000"), (150, 0.00, 0, 0, 0, "000000000000"), (6, 0.00, 0, 0, 1, "000000000000"),
    (3, 1.00, 1, 1, 0, "000000000000"), (24, 0.00, 1, 1, 0, "000000000000"), (110, 0.05, 1, 1, 0, "000000000000"), (7, 0.00, 1, 1, 1, "000000000000"),
    (20, 0.00, 1, 0, 0, "111111111111"), (35, 0.10, 1, 0, 0, "111111111111"), (60, 0.00, 1, 0, 0, "111111111111"), (90, 0.25, 1, 0, 0, "111111111111"),
    (200, 0.00, 1, 0, 0, "111111111111"), (28, 0.30, 1, 0, 0, "111111111111"), (45, 0.00, 1, 0, 0, "111111111111"), (120, 0.05, 1, 0, 0, "111111111111"),
    (14, 0.00, 1, 0, 0, "111111110010"), (12, 0.00, 1, 0, 0, "111111110010"), (17, 0.00, 1, 0, 0, "111111110010"),
    (1, 0.00, 1, 0, 0, "111111110000"), (3, 0.00, 1, 0, 0, "111111110000"), (6, 0.00, 1, 0, 0, "111111110000"), (9, 0.00, 1, 0, 0, "111111110000"),
    (2, 0.00, 1, 0, 0, "111111110000"), (5, 0.20, 1, 0, 0, "111111110000"), (8, 0.25, 1, 0, 0, "111111110000"),
    (1, 0.00, 1, 0, 1, "111111110100"), (4, 0.00, 1, 0, 1, "111111110100"), (9, 0.00, 1, 0, 1, "111111110100"), (6, 0.00, 1, 0, 1, "111111110100"),
    (1, 1.00, 1, 0, 0, "001000000000"), (2, 1.00, 1, 0, 0, "001000000000"), (5, 1.00, 1, 0, 0, "001000000000"), (12, 0.90, 1, 0, 0, "001000000000"),
    (25, 0.80, 1, 0, 0, "001000000000"), (40, 1.00, 1, 0, 0, "001000000000"), (3, 1.00, 1, 0, 1, "001000000000"), (8, 0.60, 1, 0, 0, "001000000000"),
]


@dataclass(frozen=True)
class Node:
    """A question (feature <= cut leads to low), or a leaf with its share of article text."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A tree of splits that lower Gini impurity most; ties go to the first feature and the lowest cut."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best = (1e-9, -1, 0.0)
    whole = len(y) * share * (1 - share)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= cut
            left = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if whole - left > best[0] + 1e-12:
                best = (whole - left, feature, float(cut))
    _, feature, cut = best
    if feature < 0:
        return Node(share)
    low = x[:, feature] <= cut
    return Node(share, feature, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def tree() -> Node:
    """The tree of LABELLED, each of its blocks among all of AROUND."""
    rows = [(words, density, *around, place, frame, heading, int(label)) for words, density, place, frame, heading, labels in LABELLED for around, label in zip(AROUND, labels, strict=True)]
    table = np.array(rows, float)
    return grow(table[:, :-1], table[:, -1])


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of it, of the one before and of the one after, place, frame and heading."""
    if not found:
        return np.empty((0, 9))
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words for b in found), 0], float)
    marked = any(b.inside and not b.frame for b in found)
    place = [2 if b.inside else 0 if marked else 1 for b in found]
    frame = [b.frame or not b.inside and b.words <= _RIGHTS_WORDS and bool(_RIGHTS.match(b.text)) for b in found]
    return np.stack([
        words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:],
        place, frame, [b.heading for b in found],
    ], axis=1).astype(float)


def article(page: str) -> str:
    """The article text of a page: its blocks in page order, one a line."""
    found = blocks(page)
    out = []
    for block, row in zip(found, features(found).tolist(), strict=True):
        node = tree()
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        if node.share >= 0.5:
            out.append(block.text)
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages, from the whole html.

    A null or empty html, and one without article text, gives an empty text.  Null
    ids and urls stay null and repeated rows give repeated rows.  Other columns are
    not read.  An empty table gives an empty result.
    """
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([article(x or "") for x in batch], dtype=object)

    rows = pages.select("page_id", "url", extracted(F.col("html").cast("string")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
