"""The main text of web pages by boosted trees over their nodes.

Each element is a row of features: subtree density of text, links and punctuation,
words of its class, id and role and those of its ancestors, depth, and statistics of
its siblings. Boosted trees give each node the log-odds that it is part of the article.

Decoding then labels the whole tree at once. A node is kept, dropped, or only passed
through; below a dropped node all is dropped, below a kept one a part may be dropped but
nothing is passed through. Among those labellings the one with the largest sum of
log-odds wins, found in one pass from the leaves up.

The trees are trained on pages from a grammar of page layouts, written below: article
markup of several styles among menus, notices, adverts, forms, sidebars, comments and
footers, whose labels are known. Attribute words and tags enter as the log-odds that
they showed there.

Null and empty pages give an empty text, and so does a page without an article. Unclosed
elements are closed as HTML implies. Repeated rows are extracted alike; an empty table
gives an empty result; columns besides page_id, url and html are ignored. Pages are
independent of each other: one pass, no shuffle.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.dom import INLINE, Page, features, read
from tidemark.llm.trees import Boosted

TRAINING_PAGES = 900
START, STOP = 1.5, 2.5  # log-odds that the start of a kept part, and of a dropped part in it, must win
ROWS = 60_000  # nodes scored at a time


class Grammar:
    """Random pages. Each word of the article starts with the mark U+0001, which training removes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = False

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choices("aeiounrstlmdß é".replace(" ", ""), k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
        text = " ".join(w + r.choices(["", ",", "."], [10, 1, 1])[0] for w in made)
        return text.capitalize() + r.choice([".", ".", ""])

    def attr(self, *names: str) -> str:
        """Attributes with one of the names, with noise, or without any."""
        r = self.r
        if r.random() < 0.25 and not self.named:
            return "" if r.random() < 0.6 else f' class="{r.choice(["row", "col", "box", "wrap", "inner", "block"])}"'
        name = r.choice(names)
        name = r.choice([name, name, f"{name}-{r.choice(['box', 'wrap', 'inner', 'area', 'block'])}", f"site-{name}", f"{name} col"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3)}</a>{self.r.choice(["</li>", ""])}' for _ in range(self.r.randint(low, high)))

    def tagged(self, tags: list[str], names: list[str], inside: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attr(*names)}>{inside}</{tag}>"

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            a, _, b = text.partition(" ")
            mark = r.choice(["b", "i", "em", "a", "strong", "span", "code"])
            href = ' href="/y"' if mark == "a" else ""
            end = "" if r.random() < 0.3 and mark == "b" else f"</{mark}>"
            text = f"<{mark}{href}>{a}{end} {b}"
        return text

    def boiler(self, kind: str) -> str:
        r, w = self.r, self.words
        if kind == "nav":
            return self.tagged(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "toc"], f"<ul>{self.links(2, 9)}</ul>")
        if kind == "header":
            return self.tagged(["header", "header", "div"], ["header", "masthead", "top", "banner", "branding", "logo"], f"<a href='/'>{w(1, 3)}</a><p>{w(2, 8)}</p>")
        if kind == "ad":
            return self.tagged(["div", "div", "aside", "section"] + ["p"] * self.named, ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adslot", "banner"], r.choice([w(3, 30), f"<a href='/b'>{w(2, 9)}</a>", f"<p>{w(4, 25)}</p>"]))
        if kind == "notice":
            return self.tagged(["div", "div", "section", "aside", "dialog"], ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "privacy", "message", "warning"], f"{r.choice(['<p>', ''])}{w(5, 30)}<button>{w(1, 2)}</button>")
        if kind == "form":
            return self.tagged(["form", "form", "div"], ["form", "search", "newsletter", "subscribe", "login", "signup", "contact"], f"<label>{w(1, 4)}</label><input name=q><select><option>{w(1, 2)}<option>{w(1, 2)}</select><button>{w(1, 2)}</button>")
        if kind == "side":
            return self.tagged(["aside", "aside", "div", "section"], ["sidebar", "related", "widget", "side", "recommended", "popular", "more", "rail"], f"<h{r.choice('234')}>{w(1, 4)}</h3>" + r.choice([f"<ul>{self.links(2, 7)}</ul>", f"<p>{w(5, 40)}</p>", "".join(f"<div><a href='/z'>{w(2, 7)}</a><p>{w(4, 14)}</p></div>" for _ in range(3))]))
        if kind == "share":
            return self.tagged(["div", "ul"] + ["p"] * self.named, ["share", "social", "tags", "meta", "byline", "follow"], r.choice([self.links(2, 5), w(2, 6)]))
        if kind == "comments":
            one = lambda: self.tagged(["div", "li", "article"], ["comment", "reply", "response", "message"], f"<b>{w(1, 2)}</b>{r.choice(['<p>', ''])}{w(3, 60)}")
            return self.tagged(["section", "div", "div", "ol"], ["comments", "comment", "discussion", "replies", "responses", "disqus", "respond"], f"<h3>{w(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))
        return self.tagged(["footer", "footer", "div"], ["footer", "foot", "copyright", "bottom", "legal", "colophon", "credits"], f"&copy; {w(1, 3)} &middot; {r.choice(['<p>', ''])}{w(2, 20)}" + r.choice(["", f"<ul>{self.links(1, 5)}</ul>"]))

    def article(self) -> str:
        r = self.r
        said = lambda low, high: self.inline("\1" + self.words(low, high).replace(" ", " \1"))
        many = r.choices([0, 1, r.randint(1, 4), r.randint(4, 25)], [1, 2, 4, 5])[0]
        parts = [f"<h1>{said(1, 12)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.3:
            parts.append(f"<p>{r.choice(['', '<b>'])}{said(1, 40)}<br>")
        for _ in range(many):
            kind = r.random()
            if kind < 0.15:
                parts.append(f"<p><{r.choice(['b', 'b', 'em', 'span', 'strong'])}>{said(1, 60)}{r.choice(['<br>', '</p>', ''])}")
            elif kind < 0.75:
                parts.append(f"<p{self.attr('text', 'para') if r.random() < 0.1 else ''}>{said(1, r.choice([3, 20, 80]))}{r.choice(['</p>', '</p>', ''])}")
            elif kind < 0.80:
                parts.append(f"<h{r.choice('23')}>{said(1, 8)}</h{r.choice('23')}>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{said(1, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.90:
                parts.append(f"<blockquote>{said(2, 30)}</blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{said(1, 3)}<td>{said(1, 3)}" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<div>{said(3, 60)}</div>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{said(2, 12)}</figcaption></figure>")
            else:
                self.named = True  # what stands inside the article is told by its name alone
                parts.append(self.boiler(r.choice(["ad", "ad", "share", "form"])))
                self.named = False
        if not parts:
            parts = [f"<p>{said(1, 4)}</p>"]
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{self.attr('body', 'text', 'content', 'prose')}>{body}</div>"
        return self.tagged(["article", "article", "article", "main", "div", "section"], ["article", "post", "content", "entry", "story", "main", "prose"], body)

    def page(self) -> str:
        r = self.r
        some = lambda kinds: "".join(self.boiler(k) for k in r.sample(kinds, r.randint(0, len(kinds))))
        article = self.article()
        if r.random() < 0.25:
            article = f"<main>{article}{some(['comments', 'side', 'share'])}</main>"
        if r.random() < 0.25:
            article = f"<div{self.attr('container', 'wrapper', 'page', 'layout')}>{some(['side', 'ad'])}{article}{some(['side', 'comments', 'ad'])}</div>"
        top = some(["nav", "header", "ad", "notice", "form"])
        return f"<html><body>{top}{article}{some(['comments', 'side', 'share', 'form', 'notice', 'ad'])}{some(['nav', 'footer', 'footer'])}</body></html>"


@dataclass
class Extractor:
    """Log-odds of tags and attribute words, and the trees over node features."""

    tag_odds: dict[str, float]
    token_odds: dict[str, float]
    trees: Boosted

    @classmethod
    def train(cls, pages: int = TRAINING_PAGES, seed: int = 5) -> "Extractor":
        grammar = Grammar(seed)
        read_pages = [read(grammar.page()) for _ in range(pages)]
        tags: tuple[Counter, Counter] = (Counter(), Counter())
        tokens: tuple[Counter, Counter] = (Counter(), Counter())
        shares = []
        for p in read_pages:
            good, all_ = [0.0] * len(p.tags), [0.0] * len(p.tags)
            for piece in filter(None, p.pieces):
                size = len(piece[1].strip())
                all_[piece[0]] += size
                good[piece[0]] += size * ("\1" in piece[1])
            for i in range(len(p.tags) - 1, 0, -1):
                good[p.parents[i]] += good[i]
                all_[p.parents[i]] += all_[i]
            share = np.array(good) / np.maximum(all_, 1)
            shares.append((share > 0.5, np.array(all_) > 0))
            for i, (yes, there) in enumerate(zip(*(s.tolist() for s in shares[-1]))):
                if there:
                    tags[yes][p.tags[i]] += 1
                    for t in p.names[i]:
                        tokens[yes][t] += 1
            p.pieces = [piece and (piece[0], piece[1].replace("\1", "")) for piece in p.pieces]
        odds = lambda c: {t: math.log((c[1][t] + 1) / (c[0][t] + 1)) for t in c[0].keys() | c[1].keys() if c[0][t] + c[1][t] >= 3}
        out = cls(odds(tags), odds(tokens), None)
        x = [features(p, out.tag_odds, out.token_odds) for p in read_pages]
        keep = np.concatenate([s[1] for s in shares])
        y = np.concatenate([s[0] for s in shares])[keep].astype(float)
        rows = np.concatenate([f for f, _ in x])[keep]
        out.trees = Boosted.fit(rows, y, np.ones(len(y)))
        return out

    def texts(self, sources: list[str]) -> list[str]:
        pages = [read(s) for s in sources]
        rows = [features(p, self.tag_odds, self.token_odds) for p in pages]
        logits = self.trees.logits(np.concatenate([r for r, _ in rows]))
        out, at = [], 0
        for p, (r, own) in zip(pages, rows):
            states = decode(p, logits[at : at + len(r)], own)
            at += len(r)
            out.append(" ".join("".join("\n" if x is None else x[1] for x in p.pieces if x is None or states[x[0]]).split()))
        return out


def decode(page: Page, logits: np.ndarray, own: np.ndarray) -> list[bool]:
    """Whether each node is kept, in the best labelling without contradictions.

    Inline elements are part of their block: they share its log-odds and its label. The root
    is labelled like any node, for text that stands in no other; a page without an element
    is its text.
    """
    n = len(logits)
    if n == 1:
        return [True]
    inline = [page.tags[i] in INLINE and i > 0 for i in range(n)]
    block = list(range(n))
    for i in range(1, n):
        if inline[i] and page.parents[i] > 0:
            block[i] = block[page.parents[i]]
    weight = (1.0 * (np.array(block) == np.arange(n)) + np.log1p(own) * (own > 0)) * logits[block]
    keep, drop, through = weight.tolist(), (-weight).tolist(), np.where(own > 0, -weight, 0.0).tolist()
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        k, d = keep[i], drop[i]
        drop[up] += d
        if block[i] != i:
            keep[up] += k
            through[up] += d
        else:
            keep[up] += max(k, d - STOP)
            through[up] += max(through[i], k - START, d)
    state = ["keep" if keep[0] - START > max(through[0], drop[0]) else "through"] * n
    for i in range(1, n):
        up, k, d = state[page.parents[i]], keep[i], drop[i]
        if block[i] != i:
            state[i] = "keep" if up == "keep" else "drop"
        elif up == "drop":
            state[i] = "drop"
        elif up == "keep":
            state[i] = "keep" if k >= d - STOP else "drop"
        else:
            best = max(through[i], k - START, d)
            state[i] = "keep" if best == k - START else "through" if best == through[i] else "drop"
    return [s == "keep" for s in state]


def extract(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url and text of every page."""
    model = pages.sparkSession.sparkContext.broadcast(Extractor.train(training_pages))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [s or "" for s in b.column(2).to_pylist()]
            texts, at, size = [], 0, 0
            for i, s in enumerate(sources):
                size += len(s)
                if size > 1 << 20 or i == len(sources) - 1:
                    texts += model.value.texts(sources[at : i + 1])
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(scan, "page_id long, url string, text string")
