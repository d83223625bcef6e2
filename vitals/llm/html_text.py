"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of blocks. Every node is described by the density of text
and links below it, the words in its attributes and those above it, its depth
and its siblings. Gradient-boosted trees, fitted here on generated pages with
known main text, give each node the log-odds that main text lies in it if some
lies in its parent. The most likely labelling, in which nothing below a closed
node is open, is found from the leaves up, and the text of open nodes is the
result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitals.llm.tables import carried
from vitals.llm.words import worker_state

# --- tree -----------------------------------------------------------------

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is never text of the page: raw text, parts that hold blocks, parts that hold none.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp"}
HIDDEN = {"template", "object", "dialog"}
DROPPED = {"svg", "canvas", "audio", "video", "select", "button", "datalist", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr caption ul".split()
)
#: An open element on the left ends where one on the right begins, up to a list or table.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
SCOPES = {"ul", "ol", "dl", "table", "menu", "dir", "div", "section", "article", "body"}


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "text", "links")

    def __init__(self, tag: str, tokens: frozenset, parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.text = ""  # of a leaf
        self.links = 0  # characters of a leaf's text inside links


def attribute_tokens(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    found = ATTRIBUTE.findall(attributes)
    return frozenset(t.lower() for _, value in found for t in TOKEN.findall(value))


class Holes:
    """The elements open around a place whose text is dropped, outermost first.

    A part that holds no blocks ends at the next block at the latest, and every
    part with an element around it. A hidden part that is never closed is none.
    """

    def __init__(self, page: str):
        self.page = page
        self.open: list[str] = []
        self.last: dict[str, int] = {}  # where a hidden part's last end tag stands

    def closed_after(self, tag: str, at: int) -> bool:
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>]|\Z)", self.page, re.I)), default=-1)
        return self.last[tag] >= at

    def cut(self, tag: str) -> bool:
        """Ends the innermost open element of that name and all in it."""
        if tag not in self.open:
            return False
        while self.open.pop() != tag:
            pass
        return True

    def begin(self, tag: str, at: int) -> None:
        if tag in HIDDEN:
            if self.closed_after(tag, at):
                self.open.append(tag)
            return
        if tag != "svg":  # no other such part holds one of its own kind
            self.cut(tag)
        self.open.append(tag)

    def takes(self, tag: str, closing: bool, enclosed: bool) -> bool:
        """Whether a tag of a block or link belongs to a hole; if not, holes it ends are gone.

        ``enclosed``: an element of that name is open around the holes.
        """
        if not self.open:
            return False
        if closing:
            if self.cut(tag):
                return True
        elif tag == "a" or not HIDDEN.isdisjoint(self.open):
            if tag not in VOID:
                self.open.append(tag)
            return True
        if not closing or enclosed:
            self.open.clear()
            return False
        return True


def parse(page: str) -> Node:
    """The tree of blocks of a page; every run of text is a leaf."""
    root = here = Node("#root", frozenset(), None)
    run: list[str] = []
    links = [0, 0]  # open links, characters in links of this run
    around = Counter()  # names of the blocks that are open here
    holes = Holes(page)
    at = 0

    def text(part: str) -> None:
        if part and not holes.open:
            run.append(part)
            if links[0]:
                links[1] += len(part.strip())

    def flush() -> None:
        if run:
            joined = " ".join(html.unescape("".join(run)).split())
            if joined:
                leaf = Node("#text", frozenset(), here)
                leaf.text, leaf.links = joined, min(links[1], len(joined))
                here.children.append(leaf)
            run.clear()
            links[1] = 0

    def leave(upto: Node) -> Node:
        """Ends all blocks from here up to one, itself included."""
        up = here
        while up is not upto.parent:
            around[up.tag] -= 1
            up = up.parent
        return up

    match = MARKUP.search(page)
    while match:
        text(page[at : match.start()])
        at = match.end()
        closing, tag = match.group(1), (match.group(2) or "").lower()
        empty = (match.group(3) or "").endswith("/")
        if not tag:
            pass
        elif tag in RAW:
            if not closing and not empty:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = len(page) if end is None else end.start()
                if end is not None:
                    close = page.find(">", at)
                    at = len(page) if close < 0 else close + 1
        elif tag in HIDDEN or tag in DROPPED:
            if closing:
                holes.cut(tag)
            elif not empty:
                holes.begin(tag, at)
        elif tag == "br":
            text(" ")
        elif tag == "a":
            if not holes.takes(tag, bool(closing), links[0] > 0):
                links[0] = max(0, links[0] - 1) if closing else links[0] + 1
        elif tag in BLOCKS and not holes.takes(tag, bool(closing), around[tag] > 0):
            flush()
            if closing:
                if around[tag]:
                    up = here
                    while up.tag != tag:
                        up = up.parent
                    here = leave(up)
            else:
                if here.tag == "p":
                    here = leave(here)
                if tag in ENDED_BY:
                    up = here
                    while up is not root and up.tag not in SCOPES and tag not in ENDED_BY.get(up.tag, ()):
                        up = up.parent
                    if tag in ENDED_BY.get(up.tag, ()):
                        here = leave(up)
                if tag not in VOID:
                    node = Node(tag, attribute_tokens(match.group(3) or ""), here)
                    here.children.append(node)
                    here = node
                    around[tag] += 1
                links[0] = 0
        match = MARKUP.search(page, at)
    # what follows the last tag; markup cut off by the page's end is dropped with it
    text(page[at:])
    flush()
    return root


# --- features -------------------------------------------------------------

#: What attribute words hint at; fixed words.
HINTS = {
    "main": "article content main body post entry story text prose hentry page blog",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip topbar tabs",
    "side": "sidebar aside side rail widget related recommended recommendations trending popular latest promoted",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo banner dfp outbrain taboola teaser",
    "comment": "comment comments disqus reply replies respond response responses discussion reader feedback",
    "notice": "cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe paywall warning",
    "end": "footer foot copyright colophon legal credits bottom imprint disclaimer",
    "head": "header masthead logo brand hero top",
    "form": "form search login signup signin contact register",
    "share": "share sharing social follow tags byline meta author",
}
HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
TAGS = (
    ("article", "main"),
    ("nav", "menu"),
    ("header", "hgroup"),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "legend"),
    ("ul", "ol", "li", "dl", "dd", "dt", "dir"),
    ("p", "blockquote", "pre", "figcaption"),
    ("h1",),
    ("h2", "h3", "h4", "h5", "h6"),
    ("table", "tr", "td", "th", "tbody", "thead", "tfoot"),
)
TAG_OF = {tag: i for i, tags in enumerate(TAGS) for tag in tags}
OWN = len(TAGS) + len(HINTS)
FEATURES = 2 * OWN + 21


def describe(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Nodes in page order, the parent of each (-1: none) and their features."""
    nodes: list[Node] = []
    parents: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, parent = stack.pop()
        me = len(nodes)
        nodes.append(node)
        parents.append(parent)
        stack.extend((child, me) for child in reversed(node.children))
    n = len(nodes)
    x = np.zeros((n, FEATURES), dtype=np.float32)
    chars, links, leaves, words, stops = ([0] * n for _ in range(5))
    longest, below, depth, index = ([0] * n for _ in range(4))
    paragraphs, titles, heads, titled, largest = ([0] * n for _ in range(5))
    title = 0  # the first h1 before this node
    flags: list[int] = [0] * n  # own tag and hints, one bit each
    above: list[int] = [0] * n
    for i, (node, parent) in enumerate(zip(nodes, parents)):
        if node.text:
            text = node.text
            chars[i], links[i], leaves[i] = len(text), node.links, 1
            words[i] = text.count(" ") + 1
            stops[i] = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
            longest[i] = len(text)
        tag = TAG_OF.get(node.tag)
        if tag is not None:
            flags[i] = 1 << tag
        paragraphs[i] = node.tag == "p"
        titles[i] = node.tag == "h1"
        heads[i] = node.tag in ("h2", "h3", "h4", "h5", "h6")
        titled[i] = title
        title |= titles[i]
        for token in node.tokens:
            hint = HINT_OF.get(token)
            if hint is not None:
                flags[i] |= 1 << (len(TAGS) + hint)
        if parent >= 0:
            above[i] = above[parent] | flags[parent]
            depth[i] = depth[parent] + 1
            index[i] = below[parent]
            below[parent] += 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        leaves[p] += leaves[i]
        words[p] += words[i]
        stops[p] += stops[i]
        longest[p] = max(longest[p], longest[i])
        paragraphs[p] += paragraphs[i]
        titles[p] += titles[i]
        heads[p] += heads[i]
        largest[p] = max(largest[p], chars[i])
    start, seen = [0] * n, 0
    for i in range(n):
        start[i] = seen
        seen += len(nodes[i].text)
    bits = np.array([flags, above], dtype=np.int64)
    x[:, :OWN] = (bits[0][:, None] >> np.arange(OWN)) & 1
    x[:, OWN : 2 * OWN] = (bits[1][:, None] >> np.arange(OWN)) & 1
    up = np.array([max(p, 0) for p in parents])
    c, k, lv, w = (np.array(v, dtype=np.float32) for v in (chars, links, leaves, words))
    at = 2 * OWN
    x[:, at] = np.log1p(c)
    x[:, at + 1] = k / np.maximum(c, 1)
    x[:, at + 2] = c / np.maximum(lv, 1)  # density: text per leaf
    x[:, at + 3] = np.array(stops) / np.maximum(w, 1)
    x[:, at + 4] = np.log1p(longest)
    x[:, at + 5] = c / max(chars[0], 1)
    x[:, at + 6] = c / np.maximum(c[up], 1)
    x[:, at + 7] = depth
    x[:, at + 8] = index
    x[:, at + 9] = np.array(below)[up]
    x[:, at + 10] = np.array(start) / max(seen, 1)
    x[:, at + 11] = k[up] / np.maximum(c[up], 1)
    x[:, at + 12] = np.log1p(c[up])
    x[:, at + 13] = [not node.children for node in nodes]
    x[:, at + 14] = c / np.maximum(np.array(largest, dtype=np.float32)[up], 1)  # against the longest sibling
    x[:, at + 15] = np.log1p(paragraphs)
    x[:, at + 16] = np.minimum(titles, 1)
    x[:, at + 17] = titled
    x[:, at + 18] = np.log1p(heads)
    x[:, at + 19] = np.array(paragraphs) / max(paragraphs[0], 1)
    x[:, at + 20] = np.array(titles)[up] > 0
    return nodes, np.array(parents), x


def decoded(parents: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Most likely open nodes, given that only children of open nodes can be open.

    ``odds`` are the log-odds that a node is open if its parent is. From the
    leaves up: the log-likelihood of the best labelling below an open node; a
    closed one closes all below for certain.
    """
    n = len(parents)
    odds = odds.astype(np.float64)
    closed = -np.logaddexp(0, odds)
    open_ = -np.logaddexp(0, -odds)
    for i in range(n - 1, 0, -1):
        open_[parents[i]] += max(open_[i], closed[i])
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        p = parents[i]
        out[i] = open_[i] > closed[i] and (p < 0 or out[p])
    return out


# --- boosted trees --------------------------------------------------------

TREES, DEPTH, BINS = 80, 4, 32
STEP, RIDGE, LEAST_LEAF = 0.2, 1.0, 8
#: Share of the features a tree may use, so that no single cue carries all.
FEATURE_SHARE = 0.4


class Split:
    """The best split of each node of a level among those offered."""

    def __init__(self, nodes: int):
        self.gain = np.full(nodes, 1e-9)
        self.feature = np.zeros(nodes, dtype=np.int64)
        self.cut = np.full(nodes, np.inf, dtype=np.float32)

    def offer(self, feature: int, cuts: np.ndarray, left: list[np.ndarray], totals: list[np.ndarray]) -> None:
        """``left``: [node, cut] sums of gradient, curvature and rows up to each cut."""
        if not len(cuts):
            return
        (gl, hl, cl), (gt, ht, ct) = left, (t[:, None] for t in totals)
        score = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        score[(cl < LEAST_LEAF) | (ct - cl < LEAST_LEAF)] = 0
        best = score.argmax(axis=1)
        top = score[np.arange(len(best)), best]
        better = top > self.gain
        self.gain[better] = top[better]
        self.feature[better], self.cut[better] = feature, cuts[best[better]]


class Boosted:
    """Gradient-boosted complete trees of logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        flags = np.flatnonzero(((x == 0) | (x == 1)).all(axis=0))
        yes = x[:, flags].astype(np.float64)
        edges = {
            f: np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1]))
            for f in range(x.shape[1])
            if f not in set(flags.tolist())
        }
        binned = {f: np.searchsorted(edge, x[:, f], side="left") for f, edge in edges.items()}
        self.feature = np.zeros((TREES, 2**DEPTH - 1), dtype=np.int64)
        self.cut = np.full((TREES, 2**DEPTH - 1), np.inf, dtype=np.float32)
        self.value = np.zeros((TREES, 2**DEPTH), dtype=np.float32)
        odds, every = np.zeros(len(x)), np.arange(len(x))
        draw = np.random.default_rng(SEED)
        for tree in range(TREES):
            usable = draw.random(x.shape[1]) < FEATURE_SHARE
            chance = 1 / (1 + np.exp(-odds))
            sums = (weight * (y - chance), weight * chance * (1 - chance), np.ones(len(x)))
            node = np.zeros(len(x), dtype=np.int64)  # within its level
            for level in range(DEPTH):
                n, base = 2**level, 2**level - 1
                split = Split(n)
                of_node = [np.where(node[:, None] == np.arange(n), v[:, None], 0.0) for v in sums]
                totals = [v.sum(axis=0) for v in of_node]
                zero = [t[:, None] - v.T @ yes for t, v in zip(totals, of_node)]  # [node, flag]
                for i, f in enumerate(flags):
                    if not usable[f]:
                        continue
                    split.offer(f, np.zeros(1), [z[:, i : i + 1] for z in zero], totals)
                for f, edge in edges.items():
                    if not usable[f]:
                        continue
                    key, width = node * (len(edge) + 1) + binned[f], len(edge) + 1
                    left = [np.bincount(key, v, minlength=n * width).reshape(n, width) for v in sums]
                    split.offer(f, edge, [np.cumsum(v, axis=1)[:, :-1] for v in left], totals)
                self.feature[tree, base : base + n] = split.feature
                self.cut[tree, base : base + n] = split.cut
                node = 2 * node + (x[every, split.feature[node]] > split.cut[node])
            g, h = (np.bincount(node, v, minlength=2**DEPTH) for v in sums[:2])
            self.value[tree] = STEP * g / (h + RIDGE)
            odds += self.value[tree][node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.float32)
        every = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


# --- generated pages ------------------------------------------------------

#: Pages generated for the fit, and their seed.
PAGES, SEED = 800, 20240
#: Letters of main text and of everything else, so that a node's label can be read off its text.
MAIN_LETTERS, OTHER_LETTERS = "abcdefghijklm", "nopqrstuvwxyz"


#: Shares of a page's names that tell what a node is: most pages are built of opaque ones in part or whole.
TELLING = (0.0, 0.0, 0.3, 0.7, 1.0)


class PageMaker:
    """Random pages whose main text uses letters of its own."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.telling = 1.0  # share of a page's names that tell what the node is

    def sentence(self, letters: str, low: int, high: int) -> str:
        r = self.r
        words = ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
        out = " ".join(w + ("," if r.random() < 0.08 else "") for w in words)
        return out.capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def text(self, letters: str, long: bool = True) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 4, 8]) if long else 1
        return " ".join(self.sentence(letters, 1, r.choice([3, 12, 30])) for _ in range(n))

    def attrs(self, hint: str, chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance * self.telling:
            name = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789-", k=r.randint(2, 9)))
            return r.choice(["", f' class="{name}"', f' class="x{r.randint(1, 9999)}"'])
        name = r.choice(HINTS[hint].split())
        extra = r.choice(["", "-box", "_wrap", "-1", " block", "-inner"])
        return f' {r.choice(["class", "class", "id"])}="{name}{extra}"'

    def link_list(self, hint: str, tag: str) -> str:
        r = self.r
        n = r.randint(2, 12)
        items = [f'<a href="#">{self.sentence(OTHER_LETTERS, 1, r.choice([1, 3, 9]))}</a>' for _ in range(n)]
        if r.random() < 0.7:
            body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        else:
            body = r.choice([" ", " | ", ""]).join(items)
        return f"<{tag}{self.attrs(hint, 0.4 if tag != 'div' else 0.9)}>{body}</{tag}>"

    def other(self, hint: str, tag: str = "div", long: bool = False) -> str:
        r = self.r
        n = r.randint(1, 4)
        parts = [f"<p>{self.text(OTHER_LETTERS, long)}</p>" for _ in range(n)]
        if r.random() < 0.3:
            parts.insert(0, f"<h3>{self.sentence(OTHER_LETTERS, 1, 4)}</h3>")
        if r.random() < 0.5:
            parts = [self.text(OTHER_LETTERS, long)]
        return f"<{tag}{self.attrs(hint, 1.0 if tag == 'div' else 0.5)}>{''.join(parts)}</{tag}>"

    def comments(self) -> str:
        r = self.r
        one = [f"<div{self.attrs('comment', 0.6)}><p>{self.text(OTHER_LETTERS)}</p></div>" for _ in range(r.randint(1, 6))]
        tag = r.choice(["div", "section", "ol"])
        if tag == "ol":
            one = [f"<li>{c}</li>" for c in one]
        return f"<{tag}{self.attrs('comment', 1.0)}><h3>{self.sentence(OTHER_LETTERS, 1, 3)}</h3>{''.join(one)}</{tag}>"

    def form(self) -> str:
        label = self.sentence(OTHER_LETTERS, 1, 6)
        return f"<form{self.attrs('form', 0.5)}><label>{label}</label><input><p>{self.text(OTHER_LETTERS, False)}</p></form>"

    def main(self) -> str:
        r = self.r
        parts = []
        brief = r.random() < 0.3
        if r.random() < 0.85:
            title = f"<h1>{self.sentence(MAIN_LETTERS, 1, 12)}</h1>"
            parts.append(f"<header>{title}</header>" if r.random() < 0.12 else title)
        for _ in range(1 if brief else r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if brief:
                parts.append(f"<p>{r.choice(['', '<b>'])}{self.sentence(MAIN_LETTERS, 1, 12)}{r.choice(['</p>', '<br>', ''])}")
                continue
            if kind < 0.72:
                parts.append(f"<p>{self.text(MAIN_LETTERS)}</p>")
            elif kind < 0.77:
                parts.append(f"<p><b>{self.text(MAIN_LETTERS)}<br>")
            elif kind < 0.83:
                parts.append(f"<h2>{self.sentence(MAIN_LETTERS, 1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.text(MAIN_LETTERS, False)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{self.text(MAIN_LETTERS)}</blockquote>")
            elif kind < 0.93:
                cells = "".join(f"<td>{self.sentence(MAIN_LETTERS, 1, 3)}</td>" for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.96:
                parts.append(f'<p>{self.text(MAIN_LETTERS)} <a href="#">{self.sentence(MAIN_LETTERS, 1, 4)}</a></p>')
            else:
                parts.append(f"<div><p>{self.text(MAIN_LETTERS)}</p></div>")
        inside = [self.other("advert"), self.other("share"), self.link_list("side", "aside"), self.other("notice"), self.form()]
        for block in inside:
            if r.random() < 0.12:
                parts.insert(r.randint(0, len(parts)), block)
        if r.random() < 0.06:
            parts.append(self.comments())
        body = "".join(parts)
        kind = r.random()
        if kind < 0.45:
            return f"<article{self.attrs('main', 0.4)}>{body}</article>"
        if kind < 0.65:
            return f"<main{self.attrs('main', 0.4)}>{body}</main>"
        tag = r.choice(["div", "div", "section"])
        if kind < 0.93:
            out = f"<{tag}{self.attrs('main', 1.0)}>{body}</{tag}>"
        else:
            out = f"<{tag}>{body}</{tag}>"
        return f"<div{self.attrs('main', 0.3)}>{out}</div>" if r.random() < 0.2 else out

    def page(self) -> str:
        r = self.r
        self.telling = r.choice(TELLING)
        top = [self.link_list("menu", r.choice(["nav", "nav", "div"]))]
        if r.random() < 0.5:
            top.insert(0, self.other("head", r.choice(["header", "header", "div"])))
        if r.random() < 0.3:
            top = [f"<header{self.attrs('head', 0.4)}>{''.join(top)}</header>"]
        before = [self.other("advert"), self.other("notice"), self.form(), self.other("notice", "div", True)]
        after = [
            self.link_list("side", r.choice(["aside", "div"])),
            self.other("side", r.choice(["aside", "div"]), True),
            self.comments(),
            self.other("advert"),
            self.form(),
            self.other("share"),
        ]
        middle = [b for b in before if r.random() < 0.35] + [self.main()] + [b for b in after if r.random() < 0.4]
        if r.random() < 0.1:
            middle.reverse()
        joined = "".join(middle)
        if r.random() < 0.3:
            joined = f"<div{self.attrs('main', 0.3)}>{joined}</div>"
        end = self.other("end", r.choice(["footer", "footer", "div"])) if r.random() < 0.9 else ""
        body = "".join(top) + joined + end
        if r.random() < 0.1:
            body = body[: r.randint(len(body) * 2 // 3, len(body))]
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def fit(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted on ``pages`` generated pages; a node is open if main text lies in it.

    They learn from the children of open nodes, as no others can be open.
    """
    maker = PageMaker(seed)
    rows, labels = [], []
    main = re.compile(f"[{MAIN_LETTERS}{MAIN_LETTERS.upper()}]")
    for _ in range(pages):
        nodes, parents, x = describe(parse(maker.page()))
        label = np.array([bool(node.text and main.search(node.text)) for node in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            label[parents[i]] |= label[i]
        asked = np.append(True, label[parents[1:]])
        rows.append(x[asked])
        labels.append(label[asked])
    x, y = np.concatenate(rows), np.concatenate(labels).astype(np.float64)
    return Boosted(x, y, np.ones(len(y)))


def main_texts(model: Boosted, pages: list[str | None]) -> list[str]:
    trees = [describe(parse(page or "")) for page in pages]
    odds = model.odds(np.concatenate([x for _, _, x in trees])) if trees else np.zeros(0)
    out, at = [], 0
    for nodes, parents, _ in trees:
        open_ = decoded(parents, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(node.text for node, o in zip(nodes, open_) if o and node.text))
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text of every row.

    ``text`` joins the blocks of main text in page order by two line feeds;
    white space in a block is one space. A null or empty page, and one without
    main text, gives an empty text. Null ids and URLs stay null, repeated rows
    are repeated, other columns are not read.
    """
    shared = carried(pages.sparkSession, model or worker_state("main_text", fit))  # TREES x 2**DEPTH numbers
    group = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, group):  # bounds the trees held at once
                part = batch.slice(at, group)
                texts = main_texts(trees, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"],
                )

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string")
