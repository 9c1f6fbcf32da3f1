"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree in one scan. Every element that can hold text gets features of its subtree (text, link
and tag density), its attribute tokens, its depth and place, and its siblings. Gradient-boosted trees, trained here on
pages that ``html_training`` makes up, give each node a log-odds of being article content. Decoding picks the best
labels of the whole tree under one rule: below a dropped node nothing is kept. It compares, for each node from the
leaves up, dropping its whole subtree with keeping the node and the best choice for each child, weighted by the text
that is at stake, so an ancestor and a descendant can't contradict each other.

Text: character references are decoded once, white space runs inside a block become one space, blocks are trimmed and
joined in page order by one space; nothing else is dropped or capped.

Defined cases: null or empty html, or html without kept text, gives an empty text; broken markup (unclosed, unknown
or stray tags, unclosed comments, stray quotes) is read as text and elements as far as it goes; a tag that the page's
end cuts off is dropped; pages of any length and depth are read whole, in one pass; of equal gains a node is dropped;
repeated rows give equal texts; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quarry.runtime import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("tbody tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
TEXT_TAGS = frozenset("p li td blockquote pre h1 h2 h3 h4".split())
#: Scripts, styles, drawings, form controls and the head hold no article text whatever the trees say.
SKIPPED = frozenset("head script style noscript template iframe svg title textarea select button input option".split())

#: A quote counts only after ``=``; nothing is tried twice, so a page cut inside a tag takes one pass.
_TAG = re.compile(r"""<!--(?:.*?)-->|<!--.*\Z|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "depth")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0


class _Open:
    """The open elements from the root down, with the places of each tag among them, so that no end tag climbs past what it closes."""

    def __init__(self, root: Node):
        self.chain = [root]
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []  # elements that close a paragraph
        self.solid = [0]  # elements that aren't inline

    def push(self, node: Node) -> None:
        i = len(self.chain)
        self.chain.append(node)
        self.places.setdefault(node.tag, []).append(i)
        if node.tag in CLOSES_P:
            self.barriers.append(i)
        if node.tag not in INLINE:
            self.solid.append(i)

    def cut(self, length: int) -> None:
        """Close all elements from place ``length`` on."""
        for node in self.chain[length:]:
            self.places[node.tag].pop()
        del self.chain[length:]
        for places in (self.barriers, self.solid):
            while places and places[-1] >= length:
                places.pop()

    def end(self, name: str) -> None:
        """An end tag closes the last element of its name; one of a paragraph reaches over no block. Others are stray."""
        places = self.places.get(name)
        if places and not (name == "p" and self.barriers and self.barriers[-1] > places[-1]):
            self.cut(places[-1])

    def before(self, name: str) -> None:
        """What a start tag closes: a paragraph above inline elements only, or the first of the elements that it ends in its scope."""
        if name in CLOSES_P:
            if self.chain[self.solid[-1]].tag == "p":
                self.cut(self.solid[-1])
        elif name in IMPLIED:
            ends, scope = IMPLIED[name]
            last = lambda t: (self.places.get(t) or [0])[-1]
            edge = max(map(last, scope), default=0)
            inside = [places[i] for t in ends if (places := self.places.get(t)) and (i := bisect_right(places, edge)) < len(places)]
            if inside:
                self.cut(min(inside))


def parse(page: str) -> Node:
    """The element tree; items of a node are texts and nodes in order. Time is linear in the page, whatever its tags."""
    root = Node("#root", "", None)
    open_ = _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        here = open_.chain[-1]
        if not m:
            here.items.append(page[at:])
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        if not m[4]:  # the page ends inside this tag
            break
        name = name.lower()
        if m[1]:
            open_.end(name)
            continue
        open_.before(name)
        here = open_.chain[-1]
        node = Node(name, m[3], here)
        here.items.append(node)
        if name in VOID or m[3].endswith("/") and name not in CLOSES_P and name not in INLINE:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        open_.push(node)
    return root


#: Attribute tokens that sites use for each role, one feature per group.
TOKEN_GROUPS = {
    "main": "article articlebody body content entry main post story text blogpost",
    "menu": "breadcrumb breadcrumbs crumb crumbs menu nav navbar navigation pager pagination tabs toc",
    "head": "banner brand header logo masthead topbar",
    "foot": "bottom colophon copyright footer legal",
    "side": "aside rail sidebar widget widgets",
    "advert": "ad ads adv advert advertisement promo promoted sponsor sponsored",
    "notice": "alert consent cookie cookies gdpr modal notice overlay popup toast",
    "form": "captcha form login newsletter search signin signup subscribe",
    "reader": "comment comments discuss disqus feedback replies reply respond thread",
    "share": "follow related recommended recommendations share sharing social teaser teasers trending",
    "meta": "author byline date meta tag tags timestamp",
}
_GROUP_OF = {w: i for i, ws in enumerate(TOKEN_GROUPS.values()) for w in ws.split()}
_TAGS = "article main section div p h1 h2 h3 blockquote pre ul ol li table td figure figcaption nav header footer aside form a span dl button label details body".split()
_TAG_ID = {t: i for i, t in enumerate(_TAGS)}
FEATURES = (
    *(f"tag_{t}" for t in _TAGS),
    *(f"own_{g}" for g in TOKEN_GROUPS),
    *(f"above_{g}" for g in TOKEN_GROUPS),
    "in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_article", "in_main", "in_list",
    "hidden", "depth", "log_chars", "share_of_page", "link_density", "tag_density", "block_count", "p_below", "log_mean_block",
    "place", "order", "siblings", "same_tag_siblings", "sibling_chars", "rank_chars", "punctuation", "digits", "own_text_share",
    "parent_share", "parent_links", "parent_paragraphs", "parent_punctuation",
)


@dataclass
class Element:
    """An element that takes part in decoding."""

    node: Node
    parent: int
    kids: list[int] = field(default_factory=list)
    parts: list = field(default_factory=list)  # texts and child indexes, in order; None is a block edge
    chars: int = 0
    own: int = 0
    links: int = 0
    tags: int = 0
    blocks: int = 0
    paragraphs: int = 0
    stops: int = 0
    digits: int = 0
    start: int = 0
    groups: frozenset = frozenset()
    above: frozenset = frozenset()
    inside: tuple = ()
    hidden: bool = False


_INSIDE = "nav header footer aside form article main ul".split()


def elements(root: Node) -> list[Element]:
    """Block elements in page order, parents first; inline elements belong to their block."""
    found = [Element(root, -1)]
    position = 0

    def attrs(node: Node) -> tuple[frozenset, bool]:
        if not node.attrs.strip():
            return frozenset(), False
        groups, hidden = set(), False
        for m in _ATTR.finditer(node.attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "itemprop"):
                groups.update(_GROUP_OF[t] for t in _TOKEN.findall(value) if t in _GROUP_OF)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        return frozenset(groups), hidden

    stack = [(root, 0, iter(root.items), False)]
    while stack:
        node, at, items, linked = stack[-1]
        e = found[at]
        item = next(items, stack)
        if item is stack:
            stack.pop()
            if node is e.node and e.parent >= 0:
                up = found[e.parent]
                for k in ("chars", "links", "tags", "blocks", "paragraphs", "stops", "digits"):
                    setattr(up, k, getattr(up, k) + getattr(e, k))
            continue
        if isinstance(item, str):
            text = html.unescape(item) if "&" in item else item
            e.parts.append(text)
            size = len(text.strip())
            e.chars += size
            e.own += size
            position += size
            if linked:
                e.links += size
            if size:
                e.stops += sum(map(text.count, ".,;:!?"))
                e.digits += sum(map(text.count, "0123456789"))
            continue
        if item.tag in SKIPPED:
            e.parts.append(" ")
            continue
        e.tags += 1
        if item.tag in VOID:
            e.parts.append(" ")
            continue
        if item.tag in INLINE:
            stack.append((item, at, iter(item.items), linked or item.tag == "a"))
            continue
        groups, hidden = attrs(item)
        child = Element(item, at, start=position, groups=groups, hidden=hidden or e.hidden)
        child.above = e.above | e.groups
        child.inside = tuple(max(a, b) for a, b in zip(e.inside or (0,) * len(_INSIDE), (int(item.tag == t) for t in _INSIDE), strict=True))
        child.blocks, child.paragraphs = 1, int(item.tag == "p")
        found.append(child)
        e.kids.append(len(found) - 1)
        e.parts.append(len(found) - 1)
        stack.append((item, len(found) - 1, iter(item.items), linked))
    return found


def features(es: list[Element]) -> np.ndarray:
    x = np.zeros((len(es), len(FEATURES)), np.float32)
    total = max(1, es[0].chars)
    col = {f: i for i, f in enumerate(FEATURES)}
    own0 = len(_TAGS)
    above0 = own0 + len(TOKEN_GROUPS)
    for i, e in enumerate(es):
        row, c = x[i], max(1, e.chars)
        t = _TAG_ID.get(e.node.tag)
        if t is not None:
            row[t] = 1
        for g in e.groups:
            row[own0 + g] = 1
        for g in e.above:
            row[above0 + g] = 1
        row[col["in_nav"] : col["in_nav"] + len(e.inside)] = e.inside
        row[col["hidden"] : col["order"]] = (
            e.hidden,
            min(e.node.depth, 30),
            np.log1p(e.chars),
            e.chars / total,
            e.links / c,
            e.tags / c,
            np.log1p(e.blocks),
            np.log1p(e.paragraphs),
            np.log1p(e.chars / max(1, e.blocks)),
            (e.start + e.chars / 2) / total,
        )
        row[col["punctuation"] : col["parent_share"]] = (e.stops / c, e.digits / c, e.own / c)
        if not e.kids:
            continue
        sizes = [es[k].chars for k in e.kids]
        kinds = Counter(es[k].node.tag for k in e.kids)
        for order, k in enumerate(e.kids):
            n = len(e.kids)
            x[k, col["order"] : col["punctuation"]] = (order / n, min(n, 50), kinds[es[k].node.tag] / n, np.log1p((sum(sizes) - es[k].chars) / max(1, n - 1)), es[k].chars / max(1, max(sizes)))
            x[k, col["parent_share"] :] = (e.chars / total, e.links / c, np.log1p(e.paragraphs), e.stops / c)
    return x


@dataclass
class Boosted:
    """Complete trees of equal depth: split feature, threshold, leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        found = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            found += v[at - (len(f))]
        return found


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Gradient boosting for the logistic loss on binned features, level by level."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    score = np.full(len(x), base)
    inner = (1 << depth) - 1
    fs, cs, vs = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            gain, pick, bin_ = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            tg, th = np.bincount(node, g, width), np.bincount(node, h, width)
            for f in range(x.shape[1]):
                k = len(cuts[f])
                if not k:
                    continue
                slot = node * (k + 1) + binned[:, f]
                lg = np.bincount(slot, g, width * (k + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                lh = np.bincount(slot, h, width * (k + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                value = lg**2 / (lh + 1) + (tg[:, None] - lg) ** 2 / (th[:, None] - lh + 1) - (tg**2 / (th + 1))[:, None]
                b = value.argmax(1)
                v = value[np.arange(width), b]
                better = v > gain
                gain[better], pick[better], bin_[better] = v[better], f, b[better]
            fs[t, first : first + width] = pick
            cs[t, first : first + width] = [cuts[f][b] if b >= 0 else np.inf for f, b in zip(pick, bin_, strict=True)]
            at = 2 * at + 1 + (x[np.arange(len(x)), fs[t, at]] > cs[t, at])
        leaf = at - inner
        vs[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += vs[t, leaf]
    return Boosted(fs, cs, vs, base)


def decode(es: list[Element], logit: np.ndarray) -> np.ndarray:
    """kept per element: the best labels under the rule that below a dropped element nothing is kept."""
    stake = np.array([e.own + 1.0 for e in es]) * np.clip(logit, -8, 8)
    gain = np.zeros(len(es))
    for i in range(len(es) - 1, -1, -1):  # children follow their parents
        gain[i] = max(0.0, stake[i] + sum(gain[k] for k in es[i].kids))
    kept = np.zeros(len(es), bool)
    for i, e in enumerate(es):
        kept[i] = (e.parent < 0 or kept[e.parent]) and (i == 0 or gain[i] > 0)
    return kept


def text_of(es: list[Element], kept: np.ndarray, own: np.ndarray) -> str:
    """Text of the kept elements in page order; ``own`` tells whose direct text belongs to the article."""
    found: list[str] = []

    def walk(i: int) -> None:
        stack = [(i, iter(es[i].parts))]
        while stack:
            at, parts = stack[-1]
            part = next(parts, stack)
            if part is stack:
                found.append(" ")
                stack.pop()
            elif isinstance(part, str):
                if own[at]:
                    found.append(part)
            else:
                found.append(" ")
                if kept[part]:
                    stack.append((part, iter(es[part].parts)))

    walk(0)
    return " ".join("".join(found).split())


def extract_page(page: str, model: Boosted) -> str:
    return extract_pages([page], model)[0]


def extract_pages(pages: list[str], model: Boosted) -> list[str]:
    trees = [elements(parse(p)) for p in pages]
    x = np.concatenate([features(t) for t in trees]) if trees else np.zeros((0, len(FEATURES)), np.float32)
    logit = model.raw(x)
    out, at = [], 0
    for t in trees:
        z = logit[at : at + len(t)]
        at += len(t)
        kept = decode(t, z)
        # wrappers that lead to kept text are kept, but their own stray text only if they look like content themselves
        plain = np.array([e.node.tag in TEXT_TAGS and not e.groups for e in t])
        out.append(text_of(t, kept, kept & ((z > 0) | plain)))
    return out


def extract(pages: DataFrame, model: Boosted, block: int = 64) -> DataFrame:
    """page_id, url, text, n_chars for each row; one pass, no shuffle."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o in range(0, b.num_rows, block):
                part = b.slice(o, block)
                texts = extract_pages([x or "" for x in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
