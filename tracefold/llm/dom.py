"""A lenient DOM for wrapper induction, and simple tree matching.

Parsing keeps what extraction needs: element tree, attributes that name an
element's purpose, and text. Runs of like siblings (paragraphs, list items) are
one repeated node for matching, so trees stay small however long a page is.
"""

from __future__ import annotations

import math
import re
import sys
import zlib

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"))
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "caption"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "holds", "tag", "template")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []  # children: Node or str
        self.holds = self.template = False  # holds: has most of the page's content; template: the same on all pages of the host


def parse(source: str) -> Node:
    root = Node("#root")
    stack = [root]
    at = 0
    while True:
        m = _TAG.search(source, at)
        if m is None:
            tail = source[at:]
            cut = tail.rfind("<")  # a tag cut off at the end of the page
            if cut >= 0 and re.match(r"</?[a-zA-Z]?[^<]*\Z", tail[cut:]):
                tail = tail[:cut]
            if tail:
                stack[-1].children.append(tail)
            return root
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in IMPLIED:
            closes, stop = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in closes:
                    del stack[k:]
                    break
        attrs = " ".join((a or b or c).lower() for _, a, b, c in _NAMED.findall(m[3])) if m[3] else ""
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(source, at)
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


def contents(root: Node) -> dict[int, tuple[int, int]]:
    """By id of each node: a hash of the text that it holds (with its places in the tree), and the text's characters."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if not isinstance(c, str))
    out: dict[int, tuple[int, int]] = {}
    for n in reversed(order):  # children before their parents
        value, chars = 1, 0
        for c in n.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", c).strip()
                if text:
                    value = zlib.crc32(text.encode("utf-8", "replace"), value)
                    chars += len(text)
            else:
                v, k = out[id(c)]
                if k:
                    value = zlib.crc32(v.to_bytes(4, "little"), value)
                    chars += k
        out[id(n)] = value, chars
    return out


class Shape:
    """A node for matching: tag and purpose, children with runs of like siblings merged, and the nodes it stands for."""

    __slots__ = ("children", "index", "key", "nodes")

    def __init__(self, key: str, nodes: list[Node]):
        self.key, self.nodes, self.children, self.index = key, nodes, [], -1


def shape(node: Node) -> Shape:
    """Block-level outline of a tree."""
    out = Shape(f"{node.tag}|{node.attrs}", [node])
    todo = [out]
    while todo:
        s = todo.pop()
        for n in s.nodes:
            for c in n.children:
                if isinstance(c, str) or c.tag not in BLOCK or c.tag in ("br", "hr"):
                    continue
                key = f"{c.tag}|{c.attrs}"
                if s.children and s.children[-1].key == key:
                    s.children[-1].nodes.append(c)
                else:
                    s.children.append(Shape(key, [c]))
        todo.extend(s.children)
    return out


def depth(root: Shape) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        s, d = todo.pop()
        deepest = max(deepest, d)
        todo.extend((c, d + 1) for c in s.children)
    return deepest


def number(root: Shape) -> list[Shape]:
    """All shapes in preorder, each with its index."""
    out: list[Shape] = []
    todo = [root]
    while todo:
        s = todo.pop()
        s.index = len(out)
        out.append(s)
        todo.extend(reversed(s.children))
    return out


#: Up to so many pairs of children are matched over a table of lists, more row by row in NumPy; both find the same matching.
LISTED_PAIRS = 100_000


def _signatures(children: list[Shape], known: dict) -> list[int]:
    """A number for each subtree; equal ones have the same keys in the same places."""
    own: dict[int, int] = {}
    order, todo = [], list(children)
    while todo:
        s = todo.pop()
        order.append(s)
        todo.extend(s.children)
    for s in reversed(order):  # children before their parents
        own[id(s)] = known.setdefault((s.key, tuple(own[id(c)] for c in s.children)), len(known))
    return [own[id(c)] for c in children]


def _match_rows(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """The matching of :func:`_match` for many children: like subtrees are compared once, and every r-th row of the table is
    kept, from which the way back builds the rows between again (r the root of the number of rows)."""
    n, m = len(a.children), len(b.children)
    known: dict = {}
    of_a, of_b = _signatures(a.children, known), _signatures(b.children, known)
    places: dict[str, dict[int, list[int]]] = {}
    for j, (c, sig) in enumerate(zip(b.children, of_b)):
        places.setdefault(c.key, {}).setdefault(sig, []).append(j)
    weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by subtree of a: places in b with its key, and their sizes

    def weigh(i: int) -> tuple[np.ndarray, np.ndarray]:
        if of_a[i] not in weights:
            at, sizes = [], []
            for js in places.get(a.children[i].key, {}).values():
                at += js
                sizes += [_match(a.children[i], b.children[js[0]])[0]] * len(js)
            order = np.argsort(at)
            weights[of_a[i]] = np.array(at, dtype=np.int64)[order], np.array(sizes, dtype=np.int64)[order]
        return weights[of_a[i]]

    def following(row: np.ndarray, i: int) -> np.ndarray:
        at, sizes = weigh(i)
        new = row.copy()
        new[at + 1] = np.maximum(new[at + 1], row[at] + sizes)
        return np.maximum.accumulate(new)

    step = math.isqrt(n) + 1
    row, kept = np.zeros(m + 1, dtype=np.int64), []
    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = following(row, i)
    size = int(row[m]) + 1
    pairs, j = [(a, b)], m
    for first in range((n - 1) // step * step, -1, -step):
        rows = [kept[first // step]]
        for i in range(first, min(first + step, n)):
            rows.append(following(rows[-1], i))
        i = min(first + step, n)
        while i > first and j:
            here, above = rows[i - first], rows[i - first - 1]
            at, sizes = weigh(i - 1)
            k = int(np.searchsorted(at, j - 1))
            if k < len(at) and at[k] == j - 1 and here[j] == above[j - 1] + sizes[k]:
                pairs += _match(a.children[i - 1], b.children[j - 1])[1]
                i, j = i - 1, j - 1
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return size, pairs


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: size of the largest order-preserving common tree, and its pairs."""
    # frames of Python functions don't use the machine's stack, so deep trees need only a higher limit
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * min(depth(a), depth(b))))
    return _match(a, b)


def _match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: size of the largest order-preserving common tree, and its pairs."""
    if a.key != b.key:
        return 0, []
    n, m = len(a.children), len(b.children)
    if n * m > LISTED_PAIRS:
        return _match_rows(a, b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            size = 0
            if a.children[i - 1].key == b.children[j - 1].key:
                sub[i, j] = _match(a.children[i - 1], b.children[j - 1])
                size = sub[i, j][0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size)
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if (i, j) in sub and best[i][j] == best[i - 1][j - 1] + sub[i, j][0]:
            pairs += sub[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs
