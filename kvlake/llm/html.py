"""Main text of web pages by composite text density.

Each page becomes a tree of elements (unclosed and misnested tags are mended as
browsers do for paragraphs, list items and table cells; references are decoded
within one text, never across a tag). For every node the composite density is its
characters per tag, lowered by the share of its characters and tags that lie in
links. A block's sum is that of the densities of the blocks right below it. The
block of greatest sum is the article's root. The least density on its path to
the body is the threshold for blocks beside that path: one that reaches it, with
little link text, is taken in too, and so are headings that stand before the root.
Inside the root, blocks of links are left out, as their density is nothing.

Scripts, styles and the like hold no text and go first, and so do menus, headers,
footers, sidebars and forms that their own tag names (nav, header, footer, aside,
form and controls), unless they hold a first heading, an article or a main element, or, on
a page that has none of these, half of its text. Other marks are
evidence and weigh densities only: what such a tag holds counts little, what
article or main holds counts more, and a name in class, id or role counts against
a block unless it holds a first heading or a main element. A named block is left
out if it lies inside or beside the root, never if it holds the root; names that
would take more than half of the root's text are not believed, but for those of
comments, adverts, menus and the like (SURE).

Defined cases: null, empty or textless html gives the empty text; a page without
tags is one block; ties of sums go to the node that comes later in the page; null,
repeated ids and repeated pages are extracted row by row; an empty table gives an
empty one; other columns, whatever their names, are not read and not returned;
pages of any length are read whole and nesting of any depth is handled without
recursion.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without text of the page itself.
SILENT = RAW | frozenset("head object audio video canvas".split())
#: Menus, headers, footers, sidebars and forms by tag.
BESIDE = frozenset("nav menu header footer aside form button select option dialog".split())
#: Words of class, id and role that speak against a block.
SURE = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr sidebar nav navbar navigation breadcrumb breadcrumbs footer newsletter pagination comment comments commentlist respond disqus".split())
NAMED = SURE | frozenset("sponsor promo promotion banner notice notices notification alert popup modal overlay aside menu menus header masthead topbar share sharing social related recommended recommendations subscribe subscription signup login reply replies discussion widget toolbar pager search contentinfo complementary skip".split())
BESIDE_WEIGHT, NAMED_WEIGHT, MAIN_WEIGHT = 0.05, 0.2, 3.0
_CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "caption"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_OF_HEAD = frozenset("head title meta link style script base noscript template".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Tree:
    """Elements in page order; ``items`` of a node are its texts (str) and children (int)."""

    def __init__(self, page: str):
        self.tag, self.attrs, self.parent, self.items = ["#root"], [""], [-1], [[]]
        self._build(page)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.items.append([])
        self.items[parent].append(node)
        return node

    def _build(self, page: str) -> None:
        stack, open_count, at, n, last = [0], {}, 0, len(page), page.rfind(">")

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                open_count[self.tag[stack.pop()]] -= 1

        def close(names: set[str] | frozenset, limits: set[str]) -> None:
            """Close the innermost element of these names, unless one of the limits lies in between."""
            if any(open_count.get(x) for x in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in names:
                        pop_to(depth)
                        return
                    if tag in limits:
                        return

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.items[stack[-1]].append(_text(page[at:lt]))
            if lt == n:
                break
            two = page[lt + 1 : lt + 2]
            if two in "!?" and two:
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            if lt > last:  # no tag can end any more
                self.items[stack[-1]].append(_text(page[lt:]))
                break
            m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            if not m:
                self.items[stack[-1]].append("<")
                at = lt + 1
                continue
            at, tag, attrs = m.end(), m[2].lower(), m[3]
            if m[1]:
                if open_count.get(tag):
                    close({tag}, {"table", "article", "main", "body"} - {tag} if tag in ("p", "b", "i", "a", "span", "em", "strong", "li") else {"body"} - {tag})
                elif tag == "br":
                    self._open("br", "", stack[-1])
                continue
            if tag in VOID:
                self._open(tag, attrs, stack[-1])
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, at)
                self._open(tag, attrs, stack[-1])
                if end is None:
                    at = n
                else:
                    gt = page.find(">", end.end())
                    at = n if gt < 0 else gt + 1
                continue
            if attrs.endswith("/") and tag not in BLOCK:
                self._open(tag, attrs, stack[-1])
                continue
            if tag in _CLOSES_P:
                close({"p"}, {"table", "article", "main", "section", "div", "td", "th", "li", "blockquote", "body"})
            if tag in HEADINGS:
                close(HEADINGS, BLOCK - HEADINGS)
            if tag in _SIBLINGS:
                close(*_SIBLINGS[tag])
            if tag not in _OF_HEAD:
                close({"head"}, set())
            stack.append(self._open(tag, attrs, stack[-1]))
            open_count[tag] = open_count.get(tag, 0) + 1


def _text(raw: str) -> str:
    return entities.unescape(raw) if "&" in raw else raw


def _names(attrs: str) -> set[str]:
    """Words of class, id and role."""
    return {w for m in _NAMES.finditer(attrs) for w in _WORDS.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())}


class Marks:
    """What tags and names say of each node."""

    def __init__(self, tree: Tree):
        n = len(tree.tag)
        self.main = [False] * n  # holds, or is, a first heading or a main element
        self.named, self.sure = [False] * n, [False] * n
        for k in range(1, n):
            if tree.attrs[k] and tree.tag[k] not in HEADINGS:
                words = _names(tree.attrs[k])
                self.named[k], self.sure[k] = not words.isdisjoint(NAMED), not words.isdisjoint(SURE)
        for k in range(n - 1, 0, -1):
            if self.main[k] or tree.tag[k] in ("main", "h1") or (tree.tag[k] == "article" and not self.named[k]):
                self.main[k] = True
                self.main[tree.parent[k]] = True
        self.silent = [False] * n
        article = [False] * n
        self.beside = [False] * n
        for k in range(1, n):
            up, tag = tree.parent[k], tree.tag[k]
            article[k] = article[up] or tag in ("article", "main")
            self.silent[k] = self.silent[up] or tag in SILENT or (not self.main[k] and bool(tree.attrs[k]) and bool(_HIDDEN.search(tree.attrs[k])))
            self.beside[k] = tag in BESIDE and not self.main[k] and not (tag == "header" and article[up])
            self.named[k] &= not self.main[k]
            self.sure[k] &= not self.main[k]

    def weights(self, tree: Tree) -> list[float]:
        """How much the density of each node counts: the product of all marks from the top down."""
        out = [1.0] * len(tree.tag)
        for k in range(1, len(out)):
            own = MAIN_WEIGHT if tree.tag[k] in ("article", "main") else 1.0
            out[k] = out[tree.parent[k]] * own * (BESIDE_WEIGHT if self.beside[k] else 1.0) * (NAMED_WEIGHT if self.named[k] else 1.0)
        return out


class Measures:
    """Characters and tags below each node, and those of them in links; nodes of ``gone`` count nothing."""

    def __init__(self, tree: Tree, gone: list[bool]):
        n = len(tree.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if gone[k]:
                continue
            self.chars[k] += sum(len(x.strip()) for x in tree.items[k] if isinstance(x, str))
            if tree.tag[k] == "a":
                self.link_chars[k], self.link_tags[k] = self.chars[k], self.tags[k] + 1
            if k:
                up = tree.parent[k]
                self.chars[up] += self.chars[k]
                self.tags[up] += self.tags[k] + 1
                self.link_chars[up] += self.link_chars[k]
                self.link_tags[up] += self.link_tags[k]

    def density(self, k: int, share: float) -> float:
        """Composite density; ``share`` is the body's share of link characters."""
        c, lc, t, lt = self.chars[k], self.link_chars[k], max(1, self.tags[k]), self.link_tags[k]
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = c / max(1, lc) * (t / max(1, lt))
        return c / t * math.log(max(ratio, 1.0001)) / base


def sums(tree: Tree, dense: list[float], weights: list[float]) -> list[float]:
    """The weighted densities of the blocks right below each node; other elements hand on those of their own."""
    out = [0.0] * len(tree.tag)
    for k in range(len(out) - 1, 0, -1):
        out[tree.parent[k]] += weights[k] * dense[k] if tree.tag[k] in BLOCK else out[k]
    return out


def extract(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page:
        return ""
    tree = Tree(page)
    n = len(tree.tag)
    marks = Marks(tree)
    gone = list(marks.silent)
    every = Measures(tree, gone)
    plain = every.chars[0] - every.link_chars[0]
    for k in range(1, n):
        gone[k] |= gone[tree.parent[k]] or (marks.beside[k] and (marks.main[0] or 2 * (every.chars[k] - every.link_chars[k]) < plain))
    m = Measures(tree, gone)
    chars, link_chars = m.chars, m.link_chars
    body = next((k for k in range(n) if tree.tag[k] == "body" and not gone[k]), 0)
    if chars[body] < chars[0]:
        body = 0  # text outside the body element
    share = link_chars[body] / max(1, chars[body])
    weights = marks.weights(tree)
    dense = [0.0 if gone[k] else m.density(k, share) for k in range(n)]
    total = sums(tree, dense, weights)
    root = max((k for k in range(body, n) if not gone[k] and chars[k] and tree.tag[k] in BLOCK | {"#root"}), key=lambda k: (total[k], k), default=-1)
    if root < 0:
        return ""
    if not total[root]:
        root = body  # bare text: no block holds blocks with text
    path = [root]
    while path[-1] not in (body, 0):
        path.append(tree.parent[path[-1]])
    threshold = min(dense[k] for k in path)
    keep = [False] * n
    keep[root] = True
    below = root
    for up in path[1:]:
        for k in tree.items[up]:
            if isinstance(k, int) and k != below and not gone[k] and chars[k]:
                heading = k < below and tree.tag[k] in HEADINGS
                text = tree.tag[k] in BLOCK and not marks.sure[k] and dense[k] * weights[k] >= threshold * weights[up] and 3 * link_chars[k] < chars[k]
                keep[k] = heading or text
        below = up
    inside = [False] * n
    for k in range(root + 1, n):
        inside[k] = tree.parent[k] == root or inside[tree.parent[k]]
    outer = [k for k in range(n) if inside[k] and marks.named[k] and not marks.named[tree.parent[k]] and not gone[k] and tree.tag[k] in BLOCK]
    believed = 2 * sum(chars[k] for k in outer if not marks.sure[k]) <= chars[root]
    for k in range(1, n):
        if gone[k]:
            keep[k] = False
        elif not keep[k] and keep[tree.parent[k]]:
            block = tree.tag[k] in BLOCK
            links = block and m.link_tags[k] > 1 and 2 * link_chars[k] > chars[k]
            against = block and (marks.sure[k] or (marks.named[k] and believed))
            keep[k] = not links and not against
    return _blocks(tree, keep)


def _blocks(tree: Tree, keep: list[bool]) -> str:
    blocks, run = [], []

    def end_block() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        node, at = stack.pop()
        items = tree.items[node]
        while at < len(items):
            item = items[at]
            at += 1
            if isinstance(item, str):
                if keep[node]:
                    run.append(item)
            else:
                stack.append((node, at))
                if tree.tag[item] in BLOCK:
                    end_block()
                elif tree.tag[item] == "br":
                    run.append(" ")
                stack.append((item, 0))
                break
        else:
            if tree.tag[node] in BLOCK:
                end_block()
    end_block()
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return map_batches(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
