"""Main text extraction by wrapper induction over the pages of a host.

Each host has an exemplar page (the one of least hash). Every page's tree is
aligned with its host's exemplar by simple tree matching; every aligned slot
puts out the hash of what the page holds there, and Spark counts the values of
each slot over all distinct pages. Slots that hold one value on most pages are template,
the others vary. The wrapper of a host is its content: all topmost varying slots
that aren't a menu, header, footer, sidebar, notice, advert, form or comment
area, or the article or main element that holds the largest of them. Extraction
takes their blocks in page order, with what no slot matches between and beside
them, and without such areas and without template containers inside them (a
paragraph, heading, list or table that pages share stays, so passages that many
pages share do); nothing else is dropped. Names only tell kinds of varying slots
apart, which no count can do, and stand in where a host's pages give no evidence.

A host's pages meet only in counts with map-side aggregation, and its exemplar
and wrapper are one small row, so a hot host is no hot task. Pages without an
aligned region (single pages, other layouts) fall back on the markup's names.

Defined results: null or empty html gives an empty text; a null url is a host of
its own; whole pages are read, cut-off tags at the end are dropped; repeated rows
give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import dom
from tracefold.llm.common import materialise

TEMPLATE_SHARE = 0.6
#: Inside the content a container is template if so large a share of so many distinct pages holds the same there.
INSIDE_SHARE, INSIDE_PAGES = 0.9, 4
_DROP_TAGS = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea input title head dialog menu".split())
_DROP_WORD = r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|footer|foot|header|masthead|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|widget|pager|pagination|search|skip|toolbar|copyright|disclaimer)"
_BEFORE = r"(?:site|global|main|primary|secondary|top|bottom|left|right|sticky)"
_AFTER = r"(?:bar|box|area|list|links?|items?|posts?|articles?|stories|buttons?|icons?|form|section|left|right|top|bottom|\d+)"
#: A class, id or role that is such a word, alone or with a word of place or form ("cookie-banner", "related-posts"; not "has-sidebar", "side-note").
_DROP_TOKEN = re.compile(rf"(?:{_BEFORE}[_-]+)*{_DROP_WORD}(?:[_-]+(?:{_DROP_WORD}|{_AFTER}))*")
#: Inside an article these name parts of the text too.
_OPEN_WORDS = frozenset("header masthead notice side search copyright respond disclaimer skip banner".split())
_NEVER_BY_NAME = frozenset("#root html body main article".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
_CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|article-?body|main|content|post|post-?body|entry|entry-?content|story|text)(?=$|[\s_-])")
#: What is template only together with the container that it stands in.
_NEVER_TEMPLATE = _TEXT_TAGS | frozenset("#root html body main article ul ol li dl dt dd table thead tbody tfoot tr td th caption figcaption summary".split())
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=65536)
def _drop_tokens(attrs: str) -> frozenset[str]:
    return frozenset(t for t in attrs.split() if _DROP_TOKEN.fullmatch(t))


def _dropped_by_name(node: dom.Node, in_text: bool = False) -> bool:
    if not node.attrs or node.tag in _NEVER_BY_NAME:
        return False
    found = _drop_tokens(node.attrs)
    return bool(found) and not (in_text and (node.tag in _TEXT_TAGS or found <= _OPEN_WORDS))


def _is_content(node: dom.Node) -> bool:
    return node.tag in ("article", "main") or bool(node.attrs and _CONTENT_NAMES.search(node.attrs))


def is_boilerplate(node: dom.Node, in_article: bool = False, in_text: bool = False) -> bool:
    """in_article: below a region; in_text: below an element that the markup names as content."""
    if node.tag == "header" and in_article:  # an article's own heading
        return False
    return node.tag in _DROP_TAGS or (not node.holds and _dropped_by_name(node, in_text))


def mark(root: dom.Node) -> dom.Node:
    """Set ``holds`` on the elements with most of the page's content: no name makes these boilerplate.

    The content is what main, article or content-named elements hold (those outside named
    boilerplate, if there are any), else all text.
    """
    nodes, parents, kinds, named = [root], [-1], [-1], [False]
    totals: dict[tuple[int, bool], int] = {}
    sizes, suspects, at = [], [], 0
    while at < len(nodes):
        n = nodes[at]
        size = 0
        for c in n.children:
            if isinstance(c, str):
                size += len(c.strip())
            elif c.tag not in _DROP_TAGS or c.tag == "header":
                by_name = _dropped_by_name(c)
                if by_name:
                    suspects.append(len(nodes))
                kind = 0 if c.tag == "main" else 1 if c.tag == "article" else 2 if c.attrs and _CONTENT_NAMES.search(c.attrs) else -1
                up = kinds[at]
                nodes.append(c)
                parents.append(at)
                kinds.append(up if kind < 0 or 0 <= up < kind else kind)
                named.append(named[at] or by_name)
        sizes.append(size)
        if size and kinds[at] >= 0:
            key = (kinds[at], named[at])
            totals[key] = totals.get(key, 0) + size
        at += 1
    if not suspects:
        return root
    core = next((k for inside in (False, True) for k in ((0, inside), (1, inside), (2, inside)) if totals.get(k)), None)
    weights = [z if core is None or (k, b) == core else 0 for z, k, b in zip(sizes, kinds, named, strict=True)]
    whole = sum(weights)
    for k in range(len(nodes) - 1, 0, -1):
        weights[parents[k]] += weights[k]
    for k in suspects:
        nodes[k].holds = 2 * weights[k] > whole
    return root


def blocks(node: dom.Node) -> list[str]:
    """Texts of the blocks below a region, in page order."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    todo: list = [(c, _is_content(node)) for c in reversed(node.children)]
    while todo:
        c, in_text = todo.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            now.append(c)
        elif c.template or c.tag in dom.RAW or is_boilerplate(c, True, in_text):
            if c.tag in dom.BLOCK:
                close()
        else:
            if c.tag in dom.BLOCK:
                close()
                todo.append((None, False))
                in_text = in_text or _is_content(c)
            todo.extend((x, in_text) for x in reversed(c.children))
    close()
    return out


def by_names(root: dom.Node) -> list[dom.Node]:
    """The regions that the markup itself names: articles, main, or a content element; else the body."""
    found: dict[str, list[dom.Node]] = {"article": [], "main": [], "named": [], "body": []}

    todo = [(c, False) for c in reversed(root.children)]
    while todo:
        c, taken = todo.pop()
        if isinstance(c, str) or is_boilerplate(c):
            continue
        kind = c.tag if c.tag in ("article", "main", "body") else "named" if c.attrs and _CONTENT_NAMES.search(c.attrs) else None
        if kind and not (taken and kind != "body"):
            found[kind].append(c)
        taken = taken or (kind not in (None, "body", "main"))
        todo.extend((x, taken) for x in reversed(c.children))
    for kind in ("article", "main", "named", "body"):
        if found[kind]:
            return found[kind]
    return [root]


@lru_cache(maxsize=512)
def _exemplar(source: str) -> dom.Shape:
    root = dom.shape(mark(dom.parse(source)))
    dom.number(root)
    return root


@lru_cache(maxsize=512)
def _outside_boilerplate(source: str) -> frozenset[int]:
    """The exemplar's slots outside boilerplate and below the body."""
    found, todo = set(), [_exemplar(source)]
    while todo:
        s = todo.pop()
        if not is_boilerplate(s.nodes[0]):
            if s.nodes[0].tag not in ("#root", "html", "body"):
                found.add(s.index)
            todo.extend(s.children)
    return frozenset(found)


def align(source: str, exemplar: str) -> tuple[dom.Node, list[tuple[dom.Shape, dom.Shape]]]:
    """The page's tree and (exemplar slot, page slot) pairs."""
    tree = mark(dom.parse(source))
    return tree, dom.match(_exemplar(exemplar), dom.shape(tree))[1]


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, value hash, page, characters) of every aligned slot.

    page is the hash of what the page's largest slot holds: (near) copies that differ beside it are one page.
    """
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for host, source, exemplar in zip(*(batch[c].to_pylist() for c in ("host", "html", "exemplar")), strict=True):
            outside = _outside_boilerplate(exemplar)
            tree, pairs = align(source, exemplar)
            holds = dom.contents(tree)
            found = []
            main = (0, None)
            for slot, own in pairs:
                value, chars = 1, 0
                for n in own.nodes:
                    v, k = holds[id(n)]
                    value, chars = zlib.crc32(v.to_bytes(4, "little"), value), chars + k
                found.append((slot.index, value, chars))
                if slot.index in outside and chars > main[0]:
                    main = (chars, value)
            page = found[0][1] if main[1] is None and found else main[1] or 0
            for slot, value, chars in found:
                for col, v in zip(cols, (host, slot, value, page, chars), strict=True):
                    col.append(v)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "slot", "value", "page", "chars"])


def regions(exemplar: str, varying: dict[int, float]) -> tuple[list[int], bool]:
    """The exemplar's slots that hold the content, and whether these are articles that the markup names.

    varying: slot to characters a page. If the largest slot lies in an article or main element, that
    element is the content, with varying headings outside it; else all topmost varying slots are.
    """
    top: list[int] = []
    articles: list[int] = []
    headings: list[int] = []
    best, size, best_in = -1, 0.0, -1
    todo = [(_exemplar(exemplar), -1, False)]
    while todo:
        s, article, taken = todo.pop()
        n = s.nodes[0]
        if is_boilerplate(n):
            continue
        if article < 0 and n.tag in ("article", "main"):
            article = s.index
        if s.index in varying and n.tag not in ("#root", "html", "body"):
            if varying[s.index] > size:
                best, size, best_in = s.index, varying[s.index], article
            if not taken:
                top.append(s.index)
                taken = True
            if article == s.index:
                articles.append(s.index)
            elif article < 0 and n.tag in ("h1", "h2"):
                headings.append(s.index)
        todo.extend((c, article, taken) for c in reversed(s.children))
    if best_in < 0:
        return top, False
    return sorted({best_in, *articles, *headings}), True


def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [regions(e, {s["slot"]: s["chars"] for s in v}) for e, v in zip(batch["exemplar"].to_pylist(), batch["varying"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["host"], batch["exemplar"], pa.array([r for r, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.bool_()), batch["template"]], ["host", "exemplar", "regions", "named", "template"])


def _content(tree: dom.Node, pairs: list[tuple[dom.Shape, dom.Shape]], kept: frozenset[int], named: bool) -> dom.Node | None:
    """The kept slots' nodes in page order, under one node; None if the page has none of them.

    Unless named, with the nodes that no slot of the exemplar matches, if they stand between kept
    ones or beside them without a template slot between.
    """
    slots = {id(n): slot.index for slot, own in pairs for n in own.nodes}
    above: set[int] = set()  # nodes to look into
    path: list[dom.Node] = []
    out: list = []
    todo: list = [tree]
    while todo:
        c = todo.pop()
        if c is None:
            n = path.pop()
            if id(n) in above and path:
                above.add(id(path[-1]))
        elif not isinstance(c, str) and id(c) in slots:
            if slots[id(c)] in kept:
                if path:
                    above.add(id(path[-1]))
            else:
                path.append(c)
                todo.append(None)
                todo.extend(reversed(c.children))
    todo = [tree]
    first, last = -1, -1
    while todo:
        c = todo.pop()
        at = -1 if isinstance(c, str) else slots.get(id(c), -1)
        if at in kept and at >= 0:
            c.holds = True
            first, last = len(out) if first < 0 else first, len(out)
            out.append(c)
        elif at >= 0 and (id(c) in above or c.tag in ("#root", "html", "body")):
            todo.extend(reversed(c.children))
        elif at >= 0 or (not isinstance(c, str) and is_boilerplate(c)):
            out.append(None)
        else:
            out.append(c)
    if first < 0:
        return None
    if named:
        chosen = [c for c in out if c is not None and not isinstance(c, str) and slots.get(id(c), -1) in kept]
    else:
        while first and out[first - 1] is not None:
            first -= 1
        while last + 1 < len(out) and out[last + 1] is not None:
            last += 1
        chosen = out[first : last + 1]
    region = dom.Node("#region")
    region.children = [dom.Node("br") if c is None else c for c in chosen]
    return region


def extract(source: str | None, exemplar: str | None, kept: list[int] | None, named: bool | None, template: list[int] | None = None) -> str:
    if not source:
        return ""
    if exemplar is None or not kept:
        tree, region = mark(dom.parse(source)), None
    else:
        tree, pairs = align(source, exemplar)
        constant = frozenset(template or ())
        for slot, own in pairs:
            if slot.index in constant and own.nodes[0].tag not in _NEVER_TEMPLATE:
                for n in own.nodes:
                    n.template = True
        region = _content(tree, pairs, frozenset(kept), bool(named))
    return "\n".join(t for n in ([region] if region else by_names(tree)) for t in blocks(n))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(*row) for row in zip(*(batch[c].to_pylist() for c in ("html", "exemplar", "regions", "named", "template")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def induce(pages: DataFrame) -> DataFrame:
    """(host, exemplar, regions, named, template): one small row a host."""
    rows = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("length(html) > 0")
    # the exemplar by hash of the page: combined on the map side, one page a host and task is shuffled
    picked, _ = materialise(rows.groupBy("host").agg(F.min(F.struct(F.xxhash64("html"), F.col("html").alias("exemplar"))).alias("x")).select("host", "x.exemplar"), "exemplars")
    slots = rows.join(picked, "host").mapInArrow(_slots, "host string, slot int, value long, page long, chars long")
    values = slots.groupBy("host", "slot", "value", "page").agg(F.max("chars").alias("chars")).groupBy("host", "slot", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    stats = values.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("top"), F.sum("chars").alias("chars"))
    # a slot seen on one distinct page only may be content as well, if its host's pages differ at all
    varies = (F.col("pages") >= 2) & (F.col("top") < TEMPLATE_SHARE * F.col("pages"))
    template = (F.col("chars") > 0) & (F.col("pages") >= INSIDE_PAGES) & (F.col("top") >= INSIDE_SHARE * F.col("pages"))
    told = stats.where(varies | template | (F.col("pages") == 1)).select("host", "slot", (F.col("chars") / F.col("pages")).alias("chars"), varies.alias("varies"), template.alias("template"))
    hosts = told.groupBy("host").agg(
        F.collect_list(F.when(~F.col("template"), F.struct("slot", "chars"))).alias("varying"),
        F.collect_list(F.when(F.col("template"), F.col("slot"))).alias("template"),
        F.max("varies").alias("varies"),
    )
    return picked.join(hosts.where("varies").drop("varies"), "host").mapInArrow(_wrap, "host string, exemplar string, regions array<int>, named boolean, template array<int>")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers, _ = materialise(induce(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    return rows.join(wrappers, "host", "left").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
