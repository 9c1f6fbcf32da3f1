"""Features and texts of random pages against a plain version that walks each subtree anew."""

from __future__ import annotations

import html
import math
import random

import numpy as np
import pytest

from quarry.llm import html_nodes as H

BLOCKS = "div section article nav header footer aside main form blockquote figure".split()
INLINES = "b em span code i".split()
NAMES = [w for words in H.TOKEN_GROUPS.values() for w in words.split()[:3]] + ["x1", "zz"]


class Tree:
    """An element: tag, attribute words, whether it is hidden, and its texts and elements in order."""

    def __init__(self, tag, words=(), hidden=False):
        self.tag, self.words, self.hidden, self.items = tag, words, hidden, []


def text(r: random.Random) -> str:
    return r.choice(["", " ", "\n"]) + " ".join(r.choice(["word", "a,b", "x; y!", "1999", "&", "<3", "é?", "tail."]) for _ in range(r.randint(1, 9))) + r.choice(["", "  "])


def grow(r: random.Random, tree: Tree, depth: int, flow: bool) -> Tree:
    """``flow`` tells whether blocks may stand here; paragraphs and links hold texts and inline elements only."""
    for _ in range(r.randint(0, 5)):
        kind = r.random()
        if kind < 0.4 and not (tree.items and isinstance(tree.items[-1], str)):
            tree.items.append(text(r))
        elif depth and kind < 0.75 and flow:
            tag = r.choice([*BLOCKS, "p", "ul"])
            child = Tree(tag, tuple(r.choice(NAMES) for _ in range(r.choice([0, 0, 1, 2]))), r.random() < 0.05)
            if tag == "ul":
                child.items = [grow(r, Tree("li"), depth - 1, True) for _ in range(r.randint(1, 4))]
            tree.items.append(child if tag == "ul" else grow(r, child, depth - 1, tag != "p"))
        elif depth and kind < 0.9:
            tag = r.choice(["a", *INLINES]) if tree.tag != "a" else "b"
            tree.items.append(grow(r, Tree(tag), 0, False))
        elif kind < 0.95:
            tree.items.append(Tree(r.choice(["br", "img"])))
        else:
            skipped = Tree(r.choice(["script", "style", "button"]))
            skipped.items = ["never; seen 1"]
            tree.items.append(skipped)
    return tree


def markup(t) -> str:
    if isinstance(t, str):
        return html.escape(t, quote=False)
    if t.tag in H.VOID:
        return f"<{t.tag}>"
    attrs = (f' class="{" ".join(t.words)}"' if t.words else "") + (' style="display: none"' if t.hidden else "")
    inner = "".join(t.items) if t.tag in ("script", "style") else "".join(map(markup, t.items))
    return f"<{t.tag}{attrs}>{inner}</{t.tag}>"


def shown(t: Tree):
    return [x for x in t.items if isinstance(x, str) or x.tag not in H.SKIPPED]


def texts(t: Tree, linked=False, own_only=False):
    for x in shown(t):
        if isinstance(x, str):
            yield x, linked
        elif not own_only or x.tag in H.INLINE:
            yield from texts(x, linked or x.tag == "a", own_only)


def below(t: Tree):
    for x in shown(t):
        if not isinstance(x, str):
            yield x
            yield from below(x)


def is_block(t: Tree) -> bool:
    return t.tag not in H.INLINE and t.tag not in H.VOID


def child_blocks(t: Tree):
    for x in shown(t):
        if not isinstance(x, str):
            if is_block(x):
                yield x
            else:
                yield from child_blocks(x)


def size(t: Tree) -> int:
    return sum(len(s.strip()) for s, _ in texts(t))


def groups(t: Tree) -> set[int]:
    return {i for i, ws in enumerate(H.TOKEN_GROUPS.values()) for w in t.words if w in ws.split()}


def before(root: Tree, stop: Tree) -> int:
    """Characters that stand before an element."""
    n = 0

    def walk(t) -> bool:
        nonlocal n
        for x in shown(t):
            if x is stop:
                return True
            if isinstance(x, str):
                n += len(x.strip())
            elif walk(x):
                return True
        return False

    return n if stop is root or walk(root) else 0


def plain_rows(root: Tree) -> list[dict[str, float]]:
    total, out = max(1, size(root)), []

    def visit(t: Tree, path: list[Tree], depth: int, parent: Tree | None) -> None:
        chars = size(t)
        c = max(1, chars)
        line = [x for x in path if is_block(x)]
        whole = "".join(s for s, _ in texts(t) if s.strip())
        blocks = sum(is_block(x) for x in below(t)) + (t is not root)
        paragraphs = sum(x.tag == "p" for x in below(t)) + (t.tag == "p")
        row = {f"tag_{t.tag}": 1.0} | {f"own_{g}": float(i in groups(t)) for i, g in enumerate(H.TOKEN_GROUPS)}
        row |= {f"above_{g}": float(any(i in groups(x) for x in line)) for i, g in enumerate(H.TOKEN_GROUPS)}
        row |= {f"in_{g}": float(any(x.tag == ("ul" if g == "list" else g) for x in [*line, t])) for g in "nav header footer aside form article main list".split()}
        row |= {
            "hidden": float(any(x.hidden for x in [*line, t])),
            "depth": min(depth, 30),
            "log_chars": math.log1p(chars),
            "share_of_page": chars / total,
            "link_density": sum(len(s.strip()) for s, a in texts(t, any(x.tag == "a" for x in path)) if a) / c,
            "tag_density": sum(1 for _ in below(t)) / c,
            "block_count": math.log1p(blocks),
            "p_below": math.log1p(paragraphs),
            "log_mean_block": math.log1p(chars / max(1, blocks)),
            "place": (before(root, t) + chars / 2) / total,
            "punctuation": sum(whole.count(x) for x in ".,;:!?") / c,
            "digits": sum(x in "0123456789" for x in whole) / c,
            "own_text_share": sum(len(s.strip()) for s, _ in texts(t, own_only=True)) / c,
        }
        if parent:
            kids = list(child_blocks(parent))
            sizes, up = [size(k) for k in kids], max(1, size(parent))
            rest = "".join(s for s, _ in texts(parent) if s.strip())
            row |= {
                "order": kids.index(t) / len(kids),
                "siblings": min(len(kids), 50),
                "same_tag_siblings": sum(k.tag == t.tag for k in kids) / len(kids),
                "sibling_chars": math.log1p((sum(sizes) - chars) / max(1, len(kids) - 1)),
                "rank_chars": chars / max(1, max(sizes)),
                "parent_share": size(parent) / total,
                "parent_links": sum(len(s.strip()) for s, a in texts(parent) if a) / up,
                "parent_paragraphs": math.log1p(sum(x.tag == "p" for x in below(parent)) + (parent.tag == "p")),
                "parent_punctuation": sum(rest.count(x) for x in ".,;:!?") / up,
            }
        out.append((t, row))
        descend(t, [*path, t], depth, t)

    def descend(t: Tree, path: list[Tree], depth: int, parent: Tree) -> None:
        for x in shown(t):
            if isinstance(x, str) or x.tag in H.VOID:
                continue
            if is_block(x):
                visit(x, path, depth + 1, parent)
            else:
                descend(x, [*path, x], depth + 1, parent)

    visit(root, [], 0, None)
    return out


def plain_text(t: Tree, kept: set[int], own: set[int], block: Tree) -> str:
    out = ""
    for x in t.items:
        if isinstance(x, str):
            out += x if id(block) in own else ""
        elif x.tag in H.SKIPPED or x.tag in H.VOID:
            out += " "
        elif is_block(x):
            out += " " + (plain_text(x, kept, own, x) + " " if id(x) in kept else "")
        else:
            out += plain_text(x, kept, own, block)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_features_and_texts_against_plain_version(seed):
    r = random.Random(seed)
    root = grow(r, Tree("#root"), 5, True)
    es = H.elements(H.parse("".join(map(markup, root.items))))
    got, want = H.features(es), plain_rows(root)
    assert [e.node.tag for e in es] == [t.tag for t, _ in want]
    for x, (t, row) in zip(got, want, strict=True):
        far = {k: (float(v), row.get(k, 0.0)) for k, v in zip(H.FEATURES, x, strict=True) if abs(v - row.get(k, 0.0)) > 1e-5}
        assert not far, (t.tag, far)
    for _ in range(3):
        kept, own = (np.array([r.random() < p for _ in es]) for p in (0.8, 0.7))
        pick = lambda mask: {id(t) for (t, _), m in zip(want, mask, strict=True) if m}
        assert H.text_of(es, kept, own) == " ".join(plain_text(root, pick(kept), pick(own), root).split())
