"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A page is read into its block elements; bare text beside blocks is a node of its own; inline elements
only count (links, emphasis). Each node has features of its subtree (text, density, links), of its own
tag and attribute tokens and those above it, of depth and of its siblings. Trees, boosted here in numpy
on pages that a seeded generator writes and labels, give each node a probability of being main text (or
of holding some). Decoding takes the best consistent choice: for each node keep or drop, where what is
under a dropped node is dropped, by one pass up and one down. Text directly under a kept node is output.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br picture source".split())
HIDDEN = frozenset("script style textarea title noscript iframe xmp noframes template head svg math object audio video canvas select option button input".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag that ends an open element of these, up to the scope given.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

#: Start tags that may stand in a head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

#: An attribute as browsers read it: a quote opens a string only where the value begins; an unquoted value ends at white space or ">".
_NAME = r"[^\s/>][^\s/>=]*+"
_ATTRIBUTE = _NAME + r"(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)|\Z))?+"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE + r")*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"(" + _NAME + r")(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>\"'][^\s>]*+))[\"']?)?+")
_READ = frozenset("class id role itemprop hidden aria-hidden style".split())
_SPACE = re.compile(r"[\s\x00]+")
_WORD = re.compile(r"[a-z]+")

#: Attribute tokens (parts of class, id, role) that speak for and against main text; fixed values.
GOOD = frozenset("article body content entry main post story text blog page prose hentry maincontent articlebody postbody".split())
BAD = frozenset("ad ads advert advertisement adsense banner sponsor sponsored promo promotion nav navigation navbar menu menubar header masthead topbar footer foot bottom sidebar side aside rail widget related recommended share sharing social comment comments reply replies respond disqus discussion cookie cookies consent notice alert popup modal newsletter subscribe subscription signup login form search breadcrumb breadcrumbs pagination pager tags meta copyright legal toolbar banners skip".split())

_TAGS = {t: i for i, ts in enumerate(("body html", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset label", "table tbody thead tr td th", "blockquote pre figure figcaption", "#text"), 1) for t in ts.split()}
N_TAGS = 17


class Node:
    __slots__ = ("attrs", "bad", "chars", "children", "good", "label", "links", "parent", "pieces", "stops", "tag", "tags", "words")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", labelled: bool = False):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        self.pieces: list[str] = []
        self.links = self.tags = 0
        self.label = None
        self.good = self.bad = 0
        seen = set()
        for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
            name = name.lower()
            if labelled and name == "data-main" and a in ("0", "1"):
                self.label = int(a)
            if name not in _READ or name in seen:
                continue
            seen.add(name)
            value = (a or b or c).lower()
            if name in ("hidden", "aria-hidden"):
                self.bad += value != "false"
            elif name == "style":
                self.bad += "display:none" in value.replace(" ", "")
            else:
                found = _WORD.findall(value)
                self.good += sum(x in GOOD for x in found)
                self.bad += sum(x in BAD for x in found)


class Open:
    """The open elements. Each tag's places in the stack and the places of all that aren't inline are kept, so any end tag finds its element at once."""

    def __init__(self, root: Node):
        self.root = root
        self.stack: list[tuple[str, Node]] = []  # tag, block that is open inside
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = self.hidden = 0

    def push(self, tag: str, node: Node) -> None:
        at = len(self.stack)
        self.stack.append((tag, node))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN

    def node(self) -> Node:
        return self.stack[-1][1] if self.stack else self.root

    def is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def close(self, tag: str) -> None:
        """An end tag: an inline one ends nothing across a block."""
        if self.is_open(tag):
            at = self.places[tag][-1]
            if tag not in INLINE or not self.blocks or at > self.blocks[-1]:
                self.pop_to(at)

    def imply(self, tag: str) -> None:
        """What a start tag ends: the paragraph that is open, and its like among list items, rows and cells."""
        if self.is_open("head") and tag not in IN_HEAD:
            self.pop_to(self.places["head"][0])
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if tag in ENDS:
            ended, scope = ENDS[tag]
            k = len(self.blocks) - 1
            while k >= 0:
                at = self.blocks[k]
                name = self.stack[at][0]
                if name in ended:
                    self.pop_to(at)
                elif name in scope or name != "p":
                    break
                k -= 1


def parse(page: str, labelled: bool = True) -> Node:
    """The page's block elements and bare texts, in time linear in the page. labelled: data-main is read, for training pages only."""
    root = Node("#root", None)
    opened, at_node, pos = Open(root), root, 0

    def text(piece: str) -> None:
        nonlocal at_node
        if opened.is_open("head") and opened.stack[-1][0] == "head" and not piece.isspace():
            opened.pop_to(opened.places["head"][0])
            at_node = opened.node()
        if piece and not opened.hidden:
            if "&" in piece:
                piece = html.unescape(piece)
            at_node.pieces.append(piece)
            if opened.links:
                at_node.links += len(piece)

    find, size = _TOKEN.search, len(page)
    while pos < size:
        m = find(page, pos)
        if m is None:
            text(page[pos:])
            break
        if m.start() > pos:
            text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.close(tag)
            at_node = opened.node()
            continue
        opened.imply(tag)
        at_node = opened.node()
        if tag == "br":
            text(" ")
            continue
        if tag in ("html", "body") and opened.is_open(tag):
            continue
        if tag in VOID:
            at_node.tags += 1
            if tag not in INLINE and not opened.hidden:
                at_node.pieces.append("\x00")  # a rule and the like part texts
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            pos = end.start() if end else size
            m = find(page, pos)
            pos = m.end() if m else size
            continue
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in INLINE or tag in HIDDEN:
            at_node.tags += 1
            opened.push(tag, at_node)
            continue
        node = Node(tag, at_node, m[3], labelled)
        at_node.children.append(node)
        at_node.pieces.append(node)  # keeps the place among the texts
        opened.push(tag, node)
        at_node = node
    return root


def collapsed(pieces: list[str]) -> str:
    return _SPACE.sub(" ", "".join(pieces)).strip()


def blocks(root: Node) -> tuple[list[Node], list[str | None]]:
    """Nodes in page order (parents first), and each leaf text. Text beside blocks becomes a node "#text"."""
    nodes: list[Node] = []
    texts: list[str | None] = []
    todo = [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        pieces, node.pieces = node.pieces, []
        if not node.children and "\x00" not in pieces:
            texts.append(collapsed(pieces) or None)
            continue
        texts.append(None)
        order, run = [], []
        n_links = node.links if not node.children else 0
        for x in [*pieces, "\x00"]:
            if isinstance(x, Node) or x == "\x00":
                if any(not p.isspace() for p in run):
                    leaf = Node("#text", node)
                    leaf.pieces, leaf.links = run, n_links
                    leaf.label = node.label
                    order.append(leaf)
                run = []
                if isinstance(x, Node):
                    order.append(x)
            else:
                run.append(x)
        node.children = order
        todo += reversed(order)
    return nodes, texts


FEATURES = N_TAGS + 26


def featured(nodes: list[Node], texts: list[str | None]) -> np.ndarray:
    """One row of features for each node."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    depth, good, bad = [0] * n, [0] * n, [0] * n
    chars, links, tags, stops, words, leaves, paras, long_leaves = ([0] * n for _ in range(8))
    for i, x in enumerate(nodes):
        if up[i] >= 0:
            depth[i] = depth[up[i]] + 1
            good[i], bad[i] = good[up[i]] + nodes[up[i]].good, bad[up[i]] + nodes[up[i]].bad
        if t := texts[i]:
            chars[i], words[i], leaves[i] = len(t), t.count(" ") + 1, 1
            stops[i] = t.count(".") + t.count(",") + t.count("?") + t.count("!")
            long_leaves[i] = int(len(t) > 120)
        links[i] += min(x.links, chars[i]) if texts[i] else 0
        tags[i] += x.tags + 1
        paras[i] = int(x.tag == "p")
    for i in range(n - 1, 0, -1):
        j = up[i]
        for total in (chars, links, tags, stops, words, leaves, paras, long_leaves):
            total[j] += total[i]
    at, left, right, same = [0] * n, [-1] * n, [-1] * n, [1] * n
    for x in nodes:
        own = [place[id(c)] for c in x.children]
        kinds = Counter(c.tag for c in x.children)
        for k, i in enumerate(own):
            at[i], same[i] = k, kinds[nodes[i].tag]
        left_of = dict(zip(own[1:], own, strict=False))
        for i, j in left_of.items():
            left[i], right[j] = j, i
    rows = np.zeros((n, FEATURES), np.float32)
    total = max(1, chars[0])
    before = 0
    for i, x in enumerate(nodes):
        row = rows[i]
        row[_TAGS.get(x.tag, 0)] = 1
        c = max(1, chars[i])
        p = nodes[up[i]] if up[i] >= 0 else None
        siblings = len(p.children) if p else 1
        row[N_TAGS:] = (
            depth[i],
            np.log1p(chars[i]),
            np.log1p(words[i]),
            links[i] / c,
            chars[i] / tags[i],
            stops[i] / c * 100,
            np.log1p(stops[i]),
            chars[i] / max(1, words[i]),
            chars[i] / max(1, leaves[i]),
            long_leaves[i],
            paras[i],
            chars[i] / total,
            before / total,
            x.good,
            x.bad,
            good[i],
            bad[i],
            at[i],
            siblings,
            same[i] / siblings,
            chars[i] / max(1, chars[up[i]] if up[i] >= 0 else c),
            np.log1p(chars[left[i]]) if left[i] >= 0 else -1,
            np.log1p(chars[right[i]]) if right[i] >= 0 else -1,
            links[up[i]] / max(1, chars[up[i]]) if up[i] >= 0 else 0,
            _TAGS.get(p.tag, 0) if p else 0,
            np.log1p(total),
        )
        if texts[i]:
            before += chars[i]
    return rows


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Boosted regression trees for the logistic loss, all of one depth, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.binned(x)
        n, width, leaves = len(x), x.shape[1], 1 << self.depth
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(n, self.start)
        self.feature, self.cut, self.value = (np.zeros((self.rounds, leaves), k) for k in (np.int32, np.int32, np.float64))
        offsets = np.arange(width) * self.bins
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            at = np.ones(n, np.int64)
            for _ in range(self.depth):
                for node in np.unique(at):
                    rows = np.flatnonzero(at == node)
                    flat = (binned[rows] + offsets).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], width), width * self.bins).reshape(width, self.bins).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[rows], width), width * self.bins).reshape(width, self.bins).cumsum(1)
                    gain = gs**2 / (hs + self.l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.l2)
                    gain[:, -1] = -1
                    gain[(hs < 1) | (hs[:, -1:] - hs < 1)] = -1
                    best = int(gain.argmax())
                    f, b = divmod(best, self.bins)
                    if gain[f, b] <= gs[0, -1] ** 2 / (hs[0, -1] + self.l2) + 1e-6:
                        f, b = 0, self.bins  # no split: all go left
                    self.feature[r, node], self.cut[r, node] = f, b
                at = 2 * at + (binned[np.arange(n), self.feature[r, at]] > self.cut[r, at])
            leaf = at - leaves
            gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            self.value[r] = self.rate * gs / (hs + self.l2)
            score += self.value[r, leaf]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned, rows = self.binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for r in range(self.rounds):
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (binned[rows, self.feature[r, at]] > self.cut[r, at])
            score += self.value[r, at - (1 << self.depth)]
        return 1 / (1 + np.exp(-score))


# ---------------------------------------------------------------- training pages


def made_page(rng: random.Random) -> str:
    """A page whose block elements say in data-main whether they are, or hold, main text."""
    letters = rng.choice(["etaoinshrdlucmfwypvbgkjqxz", "eéaàiouêçnrstlmdp", "enistraduhgölcmüßbä", "eaosnrildctumpñóíyq", "абвгдежзиклмнопрст", "日本語文章漢字仮名交"])
    junk = rng.choice([""] * 5 + ["&amp;&amp;&amp;", "***", "###"])

    def words(n: int) -> str:
        out = []
        for _ in range(n):
            w = "".join(rng.choices(letters, k=rng.randint(1, 9)))
            out.append((w.capitalize() if rng.random() < 0.12 else w) + (junk if junk and rng.random() < 0.7 else "") + ("." if rng.random() < 0.07 else "," if rng.random() < 0.06 else ""))
        return " ".join(out) + rng.choice([".", ".", ""])

    def named(tag: str, main: int, good: bool | None, inner: str, names: str = "") -> str:
        token = rng.choice(names.split()) if names and good is not None and rng.random() < 0.8 else rng.choice(["", "c" + words(1)[:3], f"x{rng.randint(1, 99)}", "box", "col", "row", "wrap"])
        attr = f' {rng.choice(["class", "id", "class"])}="{token}"' if token else ""
        return f'<{tag}{attr} data-main="{main}">{inner}' + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>")

    def links(n: int) -> str:
        return "".join(f'<li data-main="0"><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(n))

    def menu() -> str:
        return named(rng.choice(["nav", "nav", "div", "ul"]), 0, False, f'<ul data-main="0">{links(rng.randint(2, 9))}</ul>', "nav menu navigation navbar topmenu main-menu")

    def advert() -> str:
        return named(rng.choice(["div", "div", "aside", "section"]), 0, False, rng.choice([words(rng.randint(3, 25)), f'<p data-main="0">{words(rng.randint(3, 20))}</p>', f'<a href="x">{words(5)}</a>']), "ad ads advert banner sponsored promo advertisement")

    def side() -> str:
        return named(rng.choice(["aside", "div"]), 0, False, f'<h3 data-main="0">{words(2)}</h3>' + rng.choice([f'<ul data-main="0">{links(5)}</ul>', f'<p data-main="0">{words(rng.randint(8, 60))}</p>']), "sidebar side widget related rail")

    def notice() -> str:
        return named(rng.choice(["div", "section", "p"]), 0, False, words(rng.randint(5, 30)) + rng.choice(["", " <button>ok</button>"]), "cookie notice consent alert banner cookie-notice popup")

    def form() -> str:
        return f'<form data-main="0"><p data-main="0">{words(rng.randint(3, 15))}</p><label>{words(1)}</label><input name="q"><button>{words(1)}</button></form>'

    def comments() -> str:
        each = "".join(named(rng.choice(["div", "li", "article"]), 0, False, f'<p data-main="0"><b>{words(1)}</b> {words(1)}</p><p data-main="0">{words(rng.randint(3, 60))}</p>', "comment reply comment-body") for _ in range(rng.randint(1, 5)))
        return named(rng.choice(["section", "div"]), 0, False, f'<h3 data-main="0">{words(2)}</h3>{each}', "comments discussion replies respond")

    def header() -> str:
        return named(rng.choice(["header", "div"]), 0, False, rng.choice([f'<h1 data-main="0">{words(2)}</h1>', f'<p data-main="0">{words(3)}</p>']) + rng.choice(["", menu()]), "header masthead topbar site-header")

    def footer() -> str:
        return named(rng.choice(["footer", "footer", "div"]), 0, False, f"&copy; {words(rng.randint(1, 14))} &middot; {words(rng.randint(1, 9))}" + rng.choice(["", f'<ul data-main="0">{links(3)}</ul>', f'<p data-main="0">{words(6)}</p>']), "footer foot bottom copyright site-footer")

    def para() -> str:
        n = int(min(300, max(1, rng.lognormvariate(3.0, 1.3))))
        inner = words(n)
        if rng.random() < 0.2:
            inner = rng.choice(["<b>{}</b>", "<b>{}<br>", "{} <a href='/l'>" + words(2) + "</a> " + words(3), "<i>{}</i>", "<span>{}</span>"]).format(inner)
        return rng.choices([f'<p data-main="1">{inner}</p>', f'<p data-main="1">{inner}', named(rng.choice(["div", "section"]), 1, None, inner), f'<h2 data-main="1">{words(rng.randint(1, 8))}</h2>', f'<blockquote data-main="1">{inner}</blockquote>', f'<ul data-main="1"><li data-main="1">{words(8)}</li><li data-main="1">{inner}</li></ul>', f'<pre data-main="1">{words(9)}</pre>', f'<table data-main="1"><tr data-main="1"><td data-main="1">{words(3)}</td><td data-main="1">{words(4)}</td></tr></table>'], [70, 14, 5, 5, 2, 4, 1, 1])[0]

    inside = [para() for _ in range(rng.choice([1, 1, 2, 2, 3, 5, 8, 13, 20]) if rng.random() < 0.97 else rng.randint(30, 250))]
    for extra, chance in ((advert, 0.15), (side, 0.05), (form, 0.06), (notice, 0.06)):
        for _ in range(1 + len(inside) // 40 if rng.random() < chance else 0):
            inside.insert(rng.randint(0, len(inside)), extra())
    title = f'<h1 data-main="1">{words(rng.randint(1, 12))}</h1>' if rng.random() < 0.85 else ""
    if title and rng.random() < 0.1:
        title = f'<header data-main="1">{title}</header>'
    tail = comments() if rng.random() < 0.06 else ""
    main = named(rng.choice(["article"] * 5 + ["main", "div", "div", "section"]), 1, True if rng.random() < 0.9 else None, title + "".join(inside) + tail, "article content post main entry story article-body post-content entry-content")
    before = [f() for f, c in ((header, 0.5), (menu, 0.7), (notice, 0.2), (advert, 0.5), (form, 0.1), (side, 0.1)) if rng.random() < c]
    after = [f() for f, c in ((comments, 0.35), (side, 0.3), (advert, 0.25), (form, 0.15), (menu, 0.15), (notice, 0.1)) if rng.random() < c]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = "".join([*before, main, *after])
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        middle = named("div", 1, None, middle)
    return f'<!DOCTYPE html><html data-main="1"><head><title>{words(3)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body data-main="1">{middle}{footer() if rng.random() < 0.85 else ""}</body></html>'


#: Labelled nodes that a generated page gives to training at most, so that long pages don't outweigh short ones.
ROWS_A_PAGE = 60


def training(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes, texts = blocks(parse(made_page(rng)))
        x = featured(nodes, texts)
        keep = [i for i, node in enumerate(nodes) if node.label is not None]
        keep = sorted(rng.sample(keep, ROWS_A_PAGE)) if len(keep) > ROWS_A_PAGE else keep
        xs.append(x[keep])
        ys.append(np.array([nodes[i].label for i in keep], np.float64))
    return np.concatenate(xs), np.concatenate(ys)


@functools.cache
def trained(pages: int = 900, seed: int = 7) -> Trees:
    """The trees, boosted once in a driver; they go to the tasks."""
    return Trees().fit(*training(pages, seed))


# ---------------------------------------------------------------- decoding


def decoded(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest consistent choice of kept nodes: none under a dropped one. Root and the page's frame are kept."""
    place = {id(x): i for i, x in enumerate(nodes)}
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(len(nodes) - 1, 0, -1):
        j = place[id(nodes[i].parent)]
        keep[j] += max(keep[i], drop[i])
        drop[j] += drop[i]
    out = [False] * len(nodes)
    for i, x in enumerate(nodes):
        frame = x.parent is None or x.tag in ("html", "body")
        out[i] = frame or out[place[id(x.parent)]] and bool(keep[i] >= drop[i])
    return out


def extracted(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page: kept leaf texts in page order, joined by two newlines."""
    parsed = [blocks(parse(x, labelled=False)) for x in pages]
    p = trees.probability(np.concatenate([featured(*x) for x in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, texts in parsed:
        kept = decoded(nodes, p[at : at + len(nodes)].copy())
        at += len(nodes)
        out.append("\n\n".join(t for t, k in zip(texts, kept, strict=True) if t and k))
    return out


def main_text(pages: DataFrame, trees: Trees | None = None, key: str = "page_id", content: str = "html", others: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the other columns asked for, and the text of each page.

    Null or empty html: empty text. Malformed UTF-8 reads as U+FFFD. Null keys and repeated rows give a row each. An empty table gives
    an empty table.
    """
    trees = trees or trained()

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = extracted([x or "" for x in batch.column(0).to_pylist()], trees)
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], names=[*batch.schema.names[1:], "text"])

        return each

    rows = pages.select(F.make_valid_utf8(content).alias("__html"), key, *others)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, *others))
    return map_batches(rows, make, f"{schema}, text string")


def op4(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
