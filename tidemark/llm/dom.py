"""A lenient reader of HTML into nodes, and the features of each node."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of the HTML standard: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr img label"
    " math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mtable mtr mtd semantics annotation"
    " svg g path text tspan object canvas noscript template".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: An implied end stops at these.
SCOPE = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
    "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"},
}


_REFERENCE = re.compile(r"&#(?:([0-9]{9,})|[xX]([0-9a-fA-F]{9,}));?")
# Where an element of RAW that is never closed ends.
_BLOCK = re.compile(r"<(?:/?(?:body|html|head|div|main|article|section)|p|h[1-6]|ul|ol|dl|table|footer|header|nav|aside)\b", re.I)


def unescape(text: str) -> str:
    """Character references decoded; a number of any length that is too large is U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return "\ufffd" if len(digits) > 8 else f"&#{'' if m[1] else 'x'}{digits or 0};"

    return html.unescape(_REFERENCE.sub(short, text) if "&#" in text else text)


@dataclass
class Page:
    """Nodes in page order, parents first; pieces of text with their node; None ends a block."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    pieces: list[tuple[int, str] | None] = field(default_factory=list)


def tokens(attrs: str) -> tuple[str, ...]:
    """Lower-case words of the class, id and role of an element."""
    found = (a or b or c for a, b, c in _NAMED.findall(attrs))
    return tuple(dict.fromkeys(w.lower() for v in found for w in _PIECE.findall(v)))


def read(source: str) -> Page:
    """The nodes of a page; scripts, styles, markup and the head's title leave no text."""
    page, stack, at = Page(), [0], 0
    open_: Counter[str] = Counter()  # open elements by name, so that a stray end costs nothing

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[tags[node]] -= 1
        del stack[k:]

    tags, parents, names, pieces = page.tags, page.parents, page.names, page.pieces
    search = _TOKEN.search
    endless: set[str] = set()  # raw elements without another end
    while at < len(source):
        m = search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            pieces.append((stack[-1], unescape(text)))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            pieces.append(None)
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if tags[stack[k]] == tag:
                    close(k)
                    break
                if tag in INLINE and tags[stack[k]] not in INLINE:
                    break  # an inline end does not close a block
            continue
        if tag in RAW:
            if not (m["attrs"] or "").endswith("/"):
                if tag not in endless:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    if end is None:
                        endless.add(tag)
                if tag in endless:
                    block = _BLOCK.search(source, at)
                    at = block.start() if block else len(source)
                else:
                    at = end.end()
            continue
        if tag in CLOSES and any(open_[t] for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in SCOPE[tag]:
                    break
                if tags[stack[k]] in CLOSES[tag]:
                    close(k)
                    # a row also ends where a cell of it was open
                    if tag == "tr" and len(stack) > 1 and tags[stack[-1]] == "tr":
                        close(len(stack) - 1)
                    break
        if tag not in INLINE and tag not in VOID and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if tags[stack[k]] == "p":
                    close(k)
                    break
                if tags[stack[k]] not in INLINE:
                    break
        if tag in VOID:
            continue
        tags.append(tag)
        parents.append(stack[-1])
        names.append(tokens(m["attrs"] or "") if m["attrs"] else ())
        if not (m["attrs"] or "").endswith("/"):
            stack.append(len(tags) - 1)
            open_[tag] += 1
    return page


_MARK = re.compile(r"[.,;:!?]")


def features(page: Page, tag_odds: dict[str, float], token_odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """A row per node, and the characters of text that each node holds itself."""
    n = len(page.tags)
    own, marks, link, before = [0] * n, [0] * n, [0] * n, [-1] * n
    seen = 0
    for piece in page.pieces:
        if piece:
            size = len(piece[1].strip())
            own[piece[0]] += size
            marks[piece[0]] += len(_MARK.findall(piece[1]))
            if before[piece[0]] < 0:
                before[piece[0]] = seen
            seen += size
    text, nodes, paragraphs = own[:], [1] * n, [t == "p" for t in page.tags]
    paragraphs = [int(p) for p in paragraphs]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parents[i]].append(i)
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if page.tags[i] == "a":
            link[i] = text[i]
        text[up] += text[i]
        marks[up] += marks[i]
        link[up] += link[i]
        nodes[up] += nodes[i]
        paragraphs[up] += paragraphs[i]
        if before[i] >= 0 and (before[up] < 0 or before[i] < before[up]):
            before[up] = before[i]
    depth = [0] * n
    tag_low, tag_high, token_low, token_high = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    rows = np.zeros((n, 24))
    for i in range(n):
        odd = tag_odds.get(page.tags[i], 0.0)
        odds = [token_odds.get(t, 0.0) for t in page.names[i]]
        low, high = min(odds, default=0.0), max(odds, default=0.0)
        up = page.parents[i]
        if up >= 0:
            depth[i] = depth[up] + 1
            tag_low[i], tag_high[i] = min(odd, tag_low[up]), max(odd, tag_high[up])
            token_low[i], token_high[i] = min(low, token_low[up]), max(high, token_high[up])
        rows[i, :9] = (odd, low, high, sum(odds), tag_low[i], tag_high[i], token_low[i], token_high[i], depth[i])
    total = max(text[0], 1)
    held, size, linked, count = (np.array(a, float) for a in (own, text, link, nodes))
    rows[:, 9], rows[:, 10] = np.log1p(size), np.log1p(held)
    rows[:, 11] = linked / np.maximum(size, 1)
    rows[:, 12] = np.log1p(size / count)
    rows[:, 13] = np.array(marks) / np.maximum(size, 1)
    rows[:, 14] = np.log1p(paragraphs)
    rows[:, 15] = np.maximum(before, 0) / total
    rows[:, 16] = size / total
    for kids in children:
        if not kids:
            continue
        k = len(kids)
        here = [page.tags[c] for c in kids]
        mean = np.log1p(sum(text[c] for c in kids) / k)
        common = {t: here.count(t) / k for t in set(here)}
        rows[kids, 17] = np.arange(k) / k
        rows[kids, 18] = np.log1p(k)
        rows[kids, 19] = [common[t] for t in here]
        rows[kids, 20] = mean
    up = np.maximum(page.parents, 0)
    rows[:, 21] = rows[up, 11]
    rows[:, 22] = rows[up, 16]
    rows[:, 23] = rows[up, 14]
    return rows, held
