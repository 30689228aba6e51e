"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of its block elements (inline elements only give
text). Each node has features: its tag, classes of its attribute tokens and
those of its nearest ancestors, depth, text and link density of its subtree,
punctuation, form controls, and how it compares with its siblings. The trees
give every node a probability of being main text. Hierarchical decoding picks
the most probable labelling in which nothing below a rejected node is kept, so
an ancestor and a descendant never contradict each other.

The trees are trained here, by logistic boosting over binned features in
numpy. Examples are nodes of the ``TRAIN_PAGES`` distinct pages whose hashes
come first, ``TRAIN_NODES`` of each at most (the documented bounds), labelled by
their own markup (articles against navigation and the like), and nodes of the
same texts set into made-up layouts in which the label of each part is known.
Tags and attribute tokens are hidden in half of the pages and at random in the
layouts, so that densities, depth and siblings have to tell the labels.

Text: scripts, styles, heads, templates and comments have none; character
references are decoded; white space inside a block becomes one space, as does
<br>; blocks are joined by newlines in page order.

Defined cases: a null or empty html has an empty text; unclosed and stray tags
are mended as browsers do for paragraphs, list items and heads; an element
without text that is left open ends with the block around it; if no model can
be trained, all blocks outside navigation markup are kept; a page without a kept
block has an empty text; repeated rows each get a row; extra columns pass
through.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 300
#: What a page gives at most to the training: nodes, texts of either kind, and characters of such a text.
TRAIN_NODES, TRAIN_TEXTS, TRAIN_CHARS = 2000, 40, 2000
ROWS = 256
#: Log-odds that it takes to reject a node below a kept one.
CUT = 4.0

# Element names by kind.
BLOCKS = {
    tag: i
    for i, tag in enumerate(
        "html body div p article main section nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption address details summary fieldset dialog hr center hgroup search".split()
    )
}
SILENT = {"script", "style", "head", "template", "noscript", "svg", "iframe", "object", "select", "textarea", "button", "math", "canvas", "audio", "video", "title"}
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Silent elements in which a block of the page can't stand; such a block ends one that was left open.
FOREIGN = {"svg", "math", "select"}
#: What may stand in a head; everything else ends an open one, as browsers do.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "noscript", "title"}
ENDS_P = set(BLOCKS) - {"html", "body"}
#: Elements that an open element of the same group ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"ul", "ol", "dl", "table", "html", "body"}
AWAY = (
    "ad ads advert advertisement adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail aside footer foot header masthead topbar toolbar comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe signup login form search share sharing social related recommended recommendations trending popular more tags pagination pager widget copyright legal disclaimer contentinfo complementary".split()
)
MAIN = "article content main post entry story body text page blog articlebody articletext maincontent".split()
# Fixed values end.

_AWAY, _MAIN = set(AWAY), set(MAIN)
#: What may be markup: tags, comments and declarations.
_OPEN = re.compile(r"<[a-zA-Z/!?]")
#: A whole tag without quotes; possessive, so that a mismatch costs no more than what it read.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_VALUE = re.compile(r"=\s*+([\"'])|>")
_ATTR = re.compile(r"""(?:^|[\s/])(class|id|role|itemprop|hidden|aria-hidden|style|data-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOP = re.compile(r"[.!?;:,]")


class Node:
    __slots__ = ("tag", "up", "depth", "kids", "texts", "away", "main", "label", "chars", "link", "stops", "words", "controls", "tags")

    def __init__(self, tag: str, up: "Node | None", away: bool, main: bool, label: str | None):
        self.tag, self.up, self.away, self.main, self.label = tag, up, away, main, label
        self.depth = 0 if up is None else up.depth + 1
        self.kids: list[Node] = []
        #: Own text, child blocks where they stand, and None for other breaks.
        self.texts: list[str | Node | None] = []
        self.chars = self.link = self.stops = self.words = self.controls = self.tags = 0


def _tag(page: str, at: int, last: dict[str, int]) -> tuple[bool, str, str, int] | None:
    """The tag at a "<": whether it closes, its name, its attributes, and where it ends; None if it is no tag.

    A quote counts after an equals sign only, as in browsers. Where its end is missing, and so would be the rest of the
    page, the tag ends at the next ">". ``last`` has the last place of each quote, so nothing is looked for twice.
    """
    if m := _PLAIN.match(page, at):
        return bool(m[1]), m[2].lower(), m[3], m.end()
    m = _NAME.match(page, at)
    if not m:
        return None
    begin = end = m.end()
    while True:
        v = _VALUE.search(page, end)
        if not v:
            end = len(page)
            return page[at + 1] == "/", m[1].lower(), page[begin:end], end
        end = v.end()
        if not v[1]:
            return page[at + 1] == "/", m[1].lower(), page[begin : end - 1], end
        if last[v[1]] >= end:
            end = page.find(v[1], end) + 1


class _Open:
    """Tags that are open, counted, and those open inside the innermost list or table."""

    def __init__(self):
        self.stack: list[str] = []
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, tag: str) -> None:
        self.stack.append(tag)
        self.total[tag] = self.total.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop()
        self.total[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag


def _named(attributes: str) -> tuple[bool, bool, str | None]:
    """What the attributes say: away from the main text, main text, and a label of made-up pages."""
    away = main = False
    label = None
    for k, v in _ATTR.findall(attributes):
        k, v = k.lower(), v.strip("\"'")
        if k == "data-label":
            label = v
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v):
            away = True
        elif k != "style":
            tokens = set(_SPLIT.split(_CAMEL.sub(" ", v).lower())) | set(v.lower().split())
            away |= not tokens.isdisjoint(_AWAY)
            main |= not tokens.isdisjoint(_MAIN)
    return away, main, label


def parse(page: str) -> list[Node]:
    """All block nodes of a page, in order; the first is a root of its own. Time and memory grow with the page's length."""
    root = Node("html", None, False, False, None)
    nodes, cur = [root], root
    links, at, said = 0, 0, 0
    head = False  # whether a head is open
    silent: str | None = None  # the outermost open element without text
    inside: dict[str, int] = {}  # elements open in it, and how often it is open itself
    tags = _Open()
    last = {q: page.rfind(q) for q in "\"'"}

    def close(tag: str) -> None:
        nonlocal cur, links
        while True:
            cur = cur.up
            if tags.pop() == tag:
                break
        links = 0

    while m := _OPEN.search(page, at):
        here = m.start()
        kind = page[here + 1]
        raw = None  # text that markup encloses
        if kind in "!?":
            if page.startswith("<!--", here):
                end = page.find("-->", here + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", here):
                end = page.find("]]>", here + 9)
                raw = page[here + 9 : end if end >= 0 else len(page)]
                end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", here)
                end = len(page) if end < 0 else end + 1
            tag = None
        else:
            got = _tag(page, here, last)
            if got is None:  # "</" before something else
                at = here + 2
                continue
            closing, tag, attributes, end = got
        if said < here and not silent:
            text = page[said:here]
            if head and not text.isspace():
                head = False
            if not head:
                _say(cur, text, links)
        at = said = end
        if tag is None:
            if raw and not silent and not head:
                _say(cur, raw, links)
            continue
        if not closing and tag in RAW:
            if not silent and not head and tag == "textarea":
                cur.controls += 1
            at = said = _raw_end(page, tag, end)
            continue
        if silent:
            if closing and inside.get(tag):
                inside[tag] -= 1
                if tag == silent and not inside[tag]:
                    silent = None
                continue
            if not closing and not (silent in FOREIGN and tag in BLOCKS and not inside.get("foreignobject") or head and tag == "body"):
                if page[end - 2 : end] != "/>" or tag in BLOCKS:
                    inside[tag] = inside.get(tag, 0) + 1
                continue
            if closing and not (tag in BLOCKS and tags.total.get(tag)):
                continue
            silent = None  # left open: a block outside ends, or one begins that can't stand in it
        if head:
            if closing:
                head = tag != "head"
                continue
            if tag not in IN_HEAD:
                head = False
        if tag in SILENT:
            if not closing:
                if tag == "head":
                    head = not tags.stack
                    continue
                if tag in ("button", "select") and not head:
                    cur.controls += 1
                if page[end - 2 : end] != "/>":
                    silent, inside = tag, {tag: 1}
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            cur.texts.append(" ")
        elif tag == "input":
            cur.controls += 1
        if tag not in BLOCKS:
            cur.tags += 1
            continue
        if tag in ("html", "body"):
            continue
        if closing:
            if tags.total.get(tag):
                close(tag)
            elif tag == "p":
                cur.texts.append(None)
            continue
        if tag in ENDS_P and tags.stack and tags.stack[-1] == "p":
            tags.pop()
            cur = cur.up
        for other in SIBLINGS.get(tag, ()):
            if tags.scopes[-1].get(other):
                kept = links
                close(other)
                links = kept
        if tag == "hr":
            cur.texts.append(None)
            continue
        away, main, label = _named(attributes) if attributes else (False, False, None)
        node = Node(tag, cur, away, main, label)
        cur.texts.append(node)
        cur.kids.append(node)
        nodes.append(node)
        cur = node
        tags.push(tag)
    if said < len(page) and not silent:
        text = page[said:]
        if not head or not text.isspace():
            _say(cur, text, links)
    return nodes


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where an element of raw content ends; nothing in it is markup but its own end tag."""
    m = _RAW_END[tag].search(page, at)
    end = page.find(">", m.end()) + 1 if m else 0
    return end or len(page)


def _say(node: Node, raw: str, link: int) -> None:
    if not raw.isspace():
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text)
        node.chars += n
        node.words += text.count(" ") + 1
        node.stops += len(_STOP.findall(text))
        if link:
            node.link += n
        node.texts.append(text)
    else:
        node.texts.append(raw)


TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "td", "h1", "h2", "h3"]
TAG_OF = {t: i + 1 for i, t in enumerate(TAGS)}
NAV_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "search"}
FEATURES = 22


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    own = np.array([(x.chars, x.link, x.stops, x.words, x.controls, x.tags, x.tag == "p") for x in nodes], np.float64)
    number = {id(x): i for i, x in enumerate(nodes)}
    up = np.array([-1 if x.up is None else number[id(x.up)] for x in nodes])
    total = own.copy()
    size = np.ones(n)
    for i in range(n - 1, 0, -1):
        total[up[i]] += total[i]
        size[up[i]] += size[i]
    whole = max(1.0, total[0, 0])
    before = np.cumsum(own[:, 0]) - own[:, 0]
    x = np.zeros((n, FEATURES))
    away_up, main_up, nav_up = np.zeros(n), np.zeros(n), np.zeros(n)
    place, kin, kin_chars = np.zeros(n), np.zeros(n), np.zeros(n)
    prev_chars, next_chars = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        if i:
            p = up[i]
            away_up[i] = away_up[p] or nodes[p].away
            main_up[i] = main_up[p] or nodes[p].main or nodes[p].tag in ("article", "main")
            nav_up[i] = nav_up[p] or nodes[p].tag in NAV_TAGS
        if node.kids:
            ks = [number[id(k)] for k in node.kids]
            c = total[ks, 0]
            place[ks] = np.arange(len(ks)) / len(ks)
            kin[ks] = len(ks)
            kin_chars[ks] = c.sum() / len(ks)
            prev_chars[ks[1:]] = c[:-1]
            next_chars[ks[:-1]] = c[1:]
    chars = np.maximum(total[:, 0], 1)
    x[:, 0] = [TAG_OF.get(t.tag, 0) for t in nodes]
    x[:, 1] = [t.away for t in nodes]
    x[:, 2] = [t.main or t.tag in ("article", "main") for t in nodes]
    x[:, 3], x[:, 4], x[:, 5] = away_up, main_up, nav_up
    x[:, 6] = [t.tag in NAV_TAGS for t in nodes]
    x[:, 7] = [min(t.depth, 20) for t in nodes]
    x[:, 8] = np.log1p(total[:, 0])
    x[:, 9] = total[:, 1] / chars
    x[:, 10] = total[:, 2] / chars
    x[:, 11] = total[:, 3] / np.maximum(size, 1)
    x[:, 12] = total[:, 4]
    x[:, 13] = total[:, 0] / (size + total[:, 5])
    x[:, 14] = total[:, 6]
    x[:, 15] = total[:, 0] / whole
    x[:, 16] = before / whole
    x[:, 17] = place
    x[:, 18] = kin
    x[:, 19] = np.log1p(kin_chars)
    x[:, 20], x[:, 21] = np.log1p(prev_chars), np.log1p(next_chars)
    return x


class Boosted:
    """Logistic gradient boosting; trees are complete, over features binned at quantiles."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Boosted":
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b = self.bin(x)
        n, f = b.shape
        self.feature, self.bound, self.leaf = [], [], []
        p0 = np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99)
        self.base = float(np.log(p0 / (1 - p0)))
        s = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-s))
            g, h = (p - y) * weight, p * (1 - p) * weight
            at = np.zeros(n, np.int64)
            feature, bound = [], []
            for level in range(self.depth):
                m = 1 << level
                best = np.full(m, 1e-9)
                bf, bb = np.zeros(m, np.int64), np.full(m, self.bins)
                for j in range(f):
                    key = at * self.bins + b[:, j]
                    G = np.bincount(key, g, m * self.bins).reshape(m, -1).cumsum(1)
                    H = np.bincount(key, h, m * self.bins).reshape(m, -1).cumsum(1)
                    gain = G**2 / (H + 1) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + 1) - G[:, -1:] ** 2 / (H[:, -1:] + 1)
                    k = gain.argmax(1)
                    top = gain[np.arange(m), k]
                    up = top > best
                    best[up], bf[up], bb[up] = top[up], j, k[up]
                feature.append(bf)
                bound.append(bb)
                at = at * 2 + (b[np.arange(n), bf[at]] > bb[at])
            G, H = np.bincount(at, g, 1 << self.depth), np.bincount(at, h, 1 << self.depth)
            leaf = -self.rate * G / (H + 1)
            s += leaf[at]
            self.feature.append(feature)
            self.bound.append(bound)
            self.leaf.append(leaf)
        return self

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of being main text."""
        b = self.bin(x)
        s = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(b), np.int64)
            for bf, bb in zip(feature, bound):
                at = at * 2 + (b[rows, bf[at]] > bb[at])
            s += leaf[at]
        return s


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels with no kept node below a rejected one; the root is always open.

    Nodes weigh by the root of their own text, and a little without text; cutting a node from a kept one costs ``CUT``.
    """
    n = len(nodes)
    keep, drop = [0.0] * n, [0.0] * n
    number = {id(x): i for i, x in enumerate(nodes)}
    pos, neg = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for i in range(n - 1, -1, -1):
        w = 0.2 + nodes[i].chars ** 0.5
        keep[i] += w * pos[i]
        drop[i] += w * neg[i]
        if i:
            u = number[id(nodes[i].up)]
            keep[u] += max(keep[i], drop[i] - CUT)
            drop[u] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[number[id(nodes[i].up)]] and keep[i] > drop[i] - CUT
    # The root's own loose text isn't in any block that could be judged by its markup.
    out[0] = bool(odds[0] > 0) or not nodes[0].kids
    return out


def text(nodes: list[Node], kept: list[bool]) -> str:
    """The kept nodes' text in page order, a line for each block."""
    own = {id(x): k for x, k in zip(nodes, kept)}
    lines: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(part).split()):
            lines.append(line)
        part.clear()

    stack = [(nodes[0], iter(nodes[0].texts))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if isinstance(x, Node):
                flush()
                stack.append((x, iter(x.texts)))
                break
            if x is None:
                flush()
            elif own[id(node)]:
                part.append(x)
        else:
            flush()
            stack.pop()
    return "\n".join(lines)


# -- training --------------------------------------------------------------


def _own_label(nodes: list[Node]) -> np.ndarray:
    """Labels from a page's own markup: 1 main text, 0 not, nan unsure."""
    y = np.full(len(nodes), np.nan)
    number = {id(x): i for i, x in enumerate(nodes)}
    for i, x in enumerate(nodes):
        up = y[number[id(x.up)]] if x.up is not None else np.nan
        if up == 0 or x.tag in NAV_TAGS or x.away and not x.main:
            y[i] = 0
        elif x.tag in ("article", "main") or up == 1:
            y[i] = 1
    return y


def by_markup(nodes: list[Node]) -> np.ndarray:
    """Odds where no model could be trained: everything outside navigation and the like is main text."""
    return np.where(_own_label(nodes) == 0, -4.0, 4.0)


def _made_up(rng: random.Random, good: list[str], short: list[str]) -> str:
    """A page in a made-up layout around paragraphs of main text; data-label says which part is what."""
    esc = html.escape
    word = lambda: esc(rng.choice(short))
    named = rng.random() < 0.65

    def attr(label: int, names: list[str]) -> str:
        return f' data-label="{label}"' + (f' {rng.choice(("class", "id"))}="{rng.choice(names)}"' if named else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='#'>{word()}</a></li>" for _ in range(n)) + "</ul>"

    def away() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return f"<{'nav' if rng.random() < 0.5 else 'div'}{attr(0, ['menu', 'nav-main', 'navbar', 'breadcrumb'])}>{links(rng.randint(3, 9))}</div>"
        if kind == 1:
            return f"<aside{attr(0, ['sidebar', 'side-rail', 'widget'])}><h3>{word()}</h3>{links(rng.randint(2, 6))}<p>{word()}</p></aside>"
        if kind == 2:
            return f"<div{attr(0, ['ad', 'advert', 'sponsored', 'promo'])}>{word()} {word()}</div>"
        if kind == 3:
            return f"<div{attr(0, ['cookie-notice', 'notice', 'alert', 'newsletter'])}><p>{word()} {word()}.</p><button>ok</button></div>"
        if kind == 4:
            body = "".join(f"<div><p>{esc(rng.choice(good)[: rng.randint(20, 160)])}</p></div>" for _ in range(rng.randint(1, 4)))
            return f' <section data-label="0" class="{rng.choice(["comments", "comment-list", "replies"])}"><h3>{word()}</h3>{body}</section>'
        if kind == 5:
            return f"<form{attr(0, ['search', 'login', 'subscribe'])}><label>{word()}</label><input name=q><button>go</button></form>"
        if kind == 6:
            return f"<header{attr(0, ['header', 'masthead'])}><p>{word()}</p>{links(rng.randint(1, 4))}</header>"
        return f"<footer{attr(0, ['footer', 'copyright', 'legal'])}>&copy; {word()} <p>{word()} {word()}</p></footer>"

    paras = "".join(f"<{t}>{esc(x)}</{t}>" for x in rng.sample(good, min(len(good), rng.randint(1, 8))) for t in [rng.choice(["p", "p", "p", "div", "blockquote"])])
    if rng.random() < 0.3:
        paras += "<ul>" + "".join(f"<li>{esc(x[:90])}</li>" for x in rng.sample(good, min(len(good), 3))) + "</ul>"
    inner = away() if rng.random() < 0.4 else ""
    if rng.random() < 0.12:  # no container
        bare = "".join(f'<p data-label="1">{esc(x)}</p>' for x in rng.sample(good, min(len(good), rng.randint(1, 6))))
        return f"<html><body>{away() if rng.random() < 0.5 else ''}{bare}</body></html>"
    main = f"<{(tag := rng.choice(['article', 'main', 'div', 'section']))}{attr(1, ['content', 'post-body', 'entry', 'article-text', 'story'])}><h1>{word()}</h1>{paras}{inner}</{tag}>"
    top, end = "".join(away() for _ in range(rng.randint(0, 3))), "".join(away() for _ in range(rng.randint(1, 4)))
    wrap = rng.random() < 0.5
    return f"<html><body>{'<div>' * wrap}{top}{main}{end}{'</div>' * wrap}</body></html>"


def _forced(nodes: list[Node]) -> np.ndarray:
    y = np.full(len(nodes), np.nan)
    number = {id(x): i for i, x in enumerate(nodes)}
    for i, x in enumerate(nodes):
        up = y[number[id(x.up)]] if x.up is not None else np.nan
        y[i] = up if x.label is None else 0 if up == 0 else float(x.label)
    return y


def _own(x: Node) -> str:
    """A node's own text, in one line."""
    return " ".join("".join(t for t in x.texts if isinstance(t, str)).split())


def examples(page: str, most: int = TRAIN_NODES) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Features and labels of up to ``most`` nodes of a page, and texts of main blocks and of others.

    Every other page is seen without its tags' names and attribute tokens, so that the labels, which come from these,
    are to be told from text, links, depth and siblings.
    """
    nodes = parse(page)
    y = _own_label(nodes)
    x = features(nodes)
    if zlib.crc32(page.encode("utf-8", "replace")) & 1:
        x[:, :7] = 0
    rng = random.Random(len(nodes))
    pick = sorted(rng.sample(range(len(nodes)), most)) if len(nodes) > most else range(len(nodes))
    said = [(_own(nodes[i]), y[i]) for i in pick]
    good = [t for t, label in said if label == 1 and len(t) > 40]
    loose = [t for t, label in said if label != label and len(t) > 40]
    pick = np.array(pick, np.int64)
    known = pick[~np.isnan(y[pick])]
    return x[known], y[known], good or loose, [t for t, label in said if t and label == 0]


def train(pages: list[str], seed: int = 9) -> Boosted | None:
    return boost([examples(page) for page in pages], seed)


def boost(got: list[tuple[np.ndarray, np.ndarray, list[str], list[str]]], seed: int = 9) -> Boosted | None:
    """Trees from examples of pages and of made-up layouts around their texts; None if all have one label."""
    rng = random.Random(seed)
    xs, ys = [x for x, *_ in got if len(x)], [y for _, y, *_ in got if len(y)]
    good = [t for _, _, texts, _ in got for t in texts]
    short = [t for *_, texts in got for t in texts] or ["Home", "About us", "Read more"]
    for _ in range(2 * len(got) if good else 0):
        nodes = parse(_made_up(rng, good, short))
        for x in nodes:  # markup left out at random
            if rng.random() < 0.15:
                x.away = x.main = False
        xs.append(features(nodes))
        ys.append(_forced(nodes))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    ok = ~np.isnan(y)
    if not ok.any() or y[ok].min() == y[ok].max():
        return None
    x, y = x[ok], y[ok]
    weight = np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum()) * len(y) / 2
    return Boosted().fit(x, y, weight)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, page in zip(*(batch.column(c).to_pylist() for c in range(2))):
            x, y, good, short = examples(page)
            # A bounded part of each text will do for made-up layouts.
            parts = [[t[:TRAIN_CHARS] for t in texts[:TRAIN_TEXTS]] for texts in (good, short)]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([x.astype(np.float32).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), *(pa.array([p], pa.list_(pa.string())) for p in parts)], ["key", "x", "y", "good", "short"])


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Boosted | None:
    """Trees from the ``train_pages`` distinct pages whose hashes come first; each is parsed in a task and gives bounded examples."""
    rows = pages.select(pages[html_col].cast("string").alias("html")).filter("html <> ''").select(F.xxhash64("html").alias("key"), "html")
    keys = rows.select("key").distinct().orderBy("key").limit(train_pages)
    some = rows.join(F.broadcast(keys), "key", "left_semi")  # train_pages rows
    # Many copies of a page are one example.
    found = some.mapInArrow(_examples, "key long, x binary, y binary, good array<string>, short array<string>").groupBy("key").agg(*(F.first(c).alias(c) for c in ("x", "y", "good", "short")))
    got = sorted(found.toLocalIterator(), key=lambda r: r["key"])
    return boost([(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(r["y"]), r["good"], r["short"]) for r in got])


def extract_one(nodes: list[Node], odds: np.ndarray) -> str:
    return text(nodes, decode(nodes, odds))


def _extract(html_at: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                trees = [parse(p or "") for p in part.column(html_at).to_pylist()]
                x = [features(t) for t in trees]
                odds = model.predict(np.concatenate(x)) if model else np.concatenate([by_markup(t) for t in trees])
                cut = np.cumsum([0, *map(len, x)])
                texts = [extract_one(t, odds[b:e]) for t, b, e in zip(trees, cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(part.num_columns)] + [pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    return run


def extract(spark: SparkSession, pages: DataFrame, model: Boosted | None, html_col: str = "html") -> DataFrame:
    """The rows with the page's main text added as ``text``, in place of a column of that name."""
    if html_col == "text":
        raise ValueError("the html column must have another name than text")
    pages = pages.drop("text")
    schema = pages.select("*", F.lit("").alias("text")).schema
    return pages.mapInArrow(_extract(pages.columns.index(html_col), spark.sparkContext.broadcast(model)), schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(spark, pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
