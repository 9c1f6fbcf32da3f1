"""Made-up pages with known main text, to train the node model on."""

from __future__ import annotations

import random

import numpy as np

from quarry.llm.html_nodes import Boosted, Element, boost, elements, features, parse

_SOUNDS = "an ar be ca de el en er est fa ge ha in ion ka la le lo ma me mi na ne no on or ou pa per qu ra re ri sa se si st ta te ti to tra un ur va ve vi".split()


class PageMaker:
    """Writes pages; elements marked with the attribute ``data-main`` hold article text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SOUNDS) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        r = self.r
        found = []
        for _ in range(r.randint(low, high)):
            w = self.word()
            found.append(w + r.choice(["", "", "", "", "", ",", ".", "***", "&amp;"] if r.random() < 0.3 else [""]))
        return " ".join(found).capitalize() + "."

    def label(self, low: int, high: int) -> str:
        """Words as in a heading or an item, mostly without a full stop."""
        text = self.words(low, high)
        return text if self.r.random() < 0.3 else text.rstrip(".")

    def inline(self, low: int, high: int) -> str:
        r, text = self.r, self.words(low, high)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            t = r.choice(["b", "i", "em", "a href='/x'", "strong", "code", "span"])
            text += f" <{t}>{self.words(1, 5)}</{t.split()[0]}> {self.words(1, 10)}"
        return text

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{self.word()}'>{self.words(1, 2)[:-1]}</a></{tag}>" for _ in range(n))

    def css(self, *names: str) -> str:
        r = self.r
        n = r.choice(names)
        n = r.choice([n, f"{n}-{self.word()}", f"{self.word()} {n}", f"site-{n}", f"{n}_{r.randint(1, 9)}"])
        return r.choice([f' class="{n}"', f' id="{n}"', f' class="{n} {self.word()}"'])

    def block(self) -> str:
        """A block that isn't article text."""
        r = self.r
        kind = r.choice(["nav", "nav", "ad", "ad", "ad", "cookie", "form", "aside", "related", "comments", "share", "crumbs", "promo", "header", "footer", "meta"])
        none = r.random() < 0.15
        c = lambda *n: "" if none else self.css(*n)
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div"])
            return f"<{tag}{'' if tag == 'nav' and r.random() < 0.6 else self.css('nav', 'menu', 'navbar')}><ul>{self.links(r.randint(3, 12))}</ul></{tag}>"
        if kind in ("ad", "promo"):
            body = self.words(3, 40)
            return f"<div{self.css('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{r.choice([body, f'<p>{body}</p>', f'<a href=/x>{body}</a>'])}</div>"
        if kind == "cookie":
            return f"<div{self.css('cookie', 'consent', 'notice', 'popup')}><p>{self.words(8, 40)}</p><button>{self.word()}</button></div>"
        if kind == "form":
            return f"<form{c('newsletter', 'subscribe', 'search', 'login')}><label>{self.words(1, 4)}</label><input type=text><p>{self.words(2, 20)}</p></form>"
        if kind == "aside":
            tag = r.choice(["aside", "div"])
            return f"<{tag}{self.css('sidebar', 'aside', 'widget') if tag == 'div' else c('sidebar')}><h3>{self.label(1, 3)}</h3>{r.choice([f'<p>{self.words(5, 60)}</p>', '<ul>' + self.links(r.randint(2, 8)) + '</ul>'])}</{tag}>"
        if kind == "related":
            return f"<section{self.css('related', 'recommended', 'teasers')}><h2>{self.label(1, 3)}</h2>{self.links(r.randint(2, 6), 'div')}<p>{self.words(4, 25)}</p></section>"
        if kind == "comments":
            tag = r.choice(["div", "section", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else "div"
            posts = "".join(f"<{item}{c('comment', 'reply')}><b>{self.word()}</b><p>{self.words(4, 80)}</p></{item}>" for _ in range(r.randint(1, 8)))
            return f"<{tag}{self.css('comments', 'comment-list', 'replies', 'disqus')}>{posts}</{tag}>"
        if kind == "share":
            return f"<div{self.css('share', 'social')}>{self.links(r.randint(2, 5), 'span')}</div>"
        if kind == "crumbs":
            return f"<div{self.css('breadcrumb', 'breadcrumbs')}>{' &gt; '.join(f'<a href=/>{self.word()}</a>' for _ in range(r.randint(2, 4)))}</div>"
        if kind == "header":
            h = r.choice(["h1", "h2", "div", "div"])
            return f"<header{c('header', 'masthead')}><{h}>{self.label(1, 4)}</{h}>{r.choice(['', '<p>' + self.words(3, 14) + '</p>'])}</header>"
        if kind == "meta":
            return f"<div{self.css('byline', 'meta', 'tags')}>{self.words(1, 6)}</div>"
        if r.random() < 0.15:  # a bare line of links or words
            return f"<div>{r.choice([' | '.join(self.word() for _ in range(r.randint(2, 5))), self.label(1, 4)])}</div>"
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{self.css('footer', 'copyright') if tag == 'div' else c('footer')}>&copy; {self.word()}.example &middot; {self.words(2, 30)}</{tag}>"

    def part(self) -> str:
        r, d = self.r, " data-main"
        kind = r.random()
        if kind < 0.62:
            low, high = r.choice([(1, 3), (3, 15), (20, 120), (20, 120), (5, 40)])
            body = r.choice([self.inline, self.inline, self.words])(low, high)
            if r.random() < 0.15:
                return f"<p{d}><b>{body}<br>"
            return f"<p{d}>{body}" + r.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.74:
            h = r.choice(["h2", "h3", "h4"])
            return f"<{h}{d}>{self.label(1, 9)}</{h}>"
        if kind < 0.82:
            t = r.choice(["ul", "ol"])
            return f"<{t}{d}>" + "".join(f"<li{d}>{r.choice([self.inline, self.label])(*r.choice([(1, 6), (2, 30)]))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 7))) + f"</{t}>"
        if kind < 0.88:
            return f"<blockquote{d}>{r.choice([self.words(5, 60), f'<p{d}>{self.words(5, 60)}</p>'])}</blockquote>"
        if kind < 0.92:
            return f"<pre{d}>{self.words(4, 40)}</pre>"
        if kind < 0.96:
            return f"<table{d}>" + "".join(f"<tr{d}>" + "".join(f"<td{d}>{self.label(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure{d}><img src=x.png><figcaption{d}>{self.words(3, 20)}</figcaption></figure>"

    def article(self) -> str:
        r, d = self.r, " data-main"
        n = r.choice([1, 1, 2, 3, 4, 6, 10, 16])
        parts = [f"<h1{d}>{self.label(1, 10)}</h1>"] if r.random() < 0.9 else []
        plain, bare = r.random() < 0.1, r.random() < 0.1
        for _ in range(n):
            if bare:
                parts.append(f"<div{d}>{r.choice([self.words, self.inline])(15, 80)}</div>")
                continue
            parts.append(f"{self.words(15, 80)}<br><br>" if plain else self.part())
            if r.random() < 0.07:
                parts.append(self.block())
        if r.random() < 0.1:
            parts = [f"<div{d}>{''.join(parts[:2])}</div>", f"<section{d}>{''.join(parts[2:])}</section>"]
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        c = self.css("article", "post", "content", "entry", "story", "main") if tag in ("div", "section") and r.random() < (0.3 if bare else 0.85) else r.choice(["", "", self.css("article", "post", "content")])
        body = f"<{tag}{c}{d}>{''.join(parts)}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            w = r.choice(["div", "main", "section"])
            extra = self.block() if r.random() < 0.3 else ""
            body = f"<{w}{r.choice(['', self.css('wrapper', 'container', 'content', 'page')])}>{extra}{body}{self.block() if r.random() < 0.3 else ''}</{w}>"
        return body

    def page(self) -> str:
        r = self.r
        top = "".join(self.block() for _ in range(r.randint(0, 4)))
        end = "".join(self.block() for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{top}{self.article()}{end}</body></html>"


def _labels(es: list[Element]) -> np.ndarray:
    """1 for marked elements and for wrappers most of whose text is marked."""
    marked = np.array([e.chars if "data-main" in e.node.attrs else 0 for e in es], float)
    below = np.zeros(len(es))
    for i in range(len(es) - 1, -1, -1):
        below[i] = (es[i].own if "data-main" in es[i].node.attrs else 0) + sum(below[k] for k in es[i].kids)
    return np.array([1.0 if m or below[i] > 0.5 * max(1, e.chars) else 0.0 for i, (m, e) in enumerate(zip(marked, es, strict=True))])


def examples(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    maker, xs, ys, ws = PageMaker(seed), [], [], []
    for _ in range(pages):
        es = elements(parse(maker.page()))
        xs.append(features(es))
        ys.append(_labels(es))
        ws.append(np.array([1.0 + np.log1p(e.chars) / 3 for e in es]))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)


def train_node_model(pages: int = 700, seed: int = 1) -> Boosted:
    """Trained on a fixed number of made-up pages; the same for every input."""
    x, y, w = examples(pages, seed)
    return boost(x, y, w)
