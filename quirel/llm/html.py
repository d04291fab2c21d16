"""Main text of web pages by wrapper induction.

The folded trees of all different pages of a host are aligned by simple tree matching and merged into the host's
reference tree, few at a time and in rounds. Every page of the host is then aligned to it, and what each of its nodes holds is counted over
all pages: nodes whose text stays the same, or comes back on other pages, are template, those whose text varies are
slots, and the lowest node that holds the slots bounds the content. A page's text is that of its slots. Names of
elements decide only what alignment can't: slots that name themselves comments, adverts or menus, and
pages of hosts with too few pages. Wrappers are joined to pages; pages are never grouped.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, few, map_texts, stored

#: The fewest different pages of a host that make a wrapper.
FEWEST = 3
#: Trees, and characters of them, that are merged at a time. What hosts have more of takes more rounds.
FAN, FAN_CHARS = 256, 32_000_000
#: Characters of all wrappers and of one up to which they are broadcast, and parts that a host's rows are dealt to otherwise.
BROADCAST_CHARS, LONG, SALT = 16_000_000, 20_000, 32
#: Pairs of nodes up to which each has its own size; in larger trees those of equal subtrees share one.
PAIRS = 200_000
#: Children from which on a row of a matching's table is computed at once.
WIDE = 32
#: Share of pages with the same text that makes a node template, and of a slot's text in links that makes it a menu.
SAME, LINKED = 0.8, 0.6
#: Words that a text begins with: where they are the same on all pages, as in a line with a site's name, it is template.
BEGIN = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe head title textarea select option datalist noembed noframes".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
IN_HEAD = frozenset("base link meta script style title noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements within a line: their text is that of the element around them.
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em embed font i img input ins kbd label map mark math meter object output picture progress q rp rt ruby s samp small source span strike strong sub sup svg time track tt u var video wbr".split())
#: Tags that end an open one of the second set, up to the nearest of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS |= {t: (frozenset(["p"]), frozenset(["button", "td", "th", "table", "article", "section", "div", "li", "body"])) for t in BLOCK - {"li", "dt", "dd", "tr", "td", "th", "html", "body", "tbody", "thead", "tfoot"}}
ASIDE_TAGS = frozenset("nav aside footer form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of classes and ids that name what isn't the article.
ASIDE_WORDS = frozenset("nav navbar navigation menu menubar topbar header masthead footer sidebar aside rail ad ads advert adverts advertisement advertising adbox adslot banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar copyright".split())
INNER_OK = frozenset(["header", "masthead"])

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name: its end, or an attribute. A quote counts only where a value begins.
_ATTR = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+(?!\s*+=\s*+["']))""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_SPLIT = re.compile(r"[^a-z]+")
_NUMBERS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "attrs", "children", "mark")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        names = " ".join(sorted(attrs.get("class", "").split())[:3]) if attrs else ""
        self.mark = tag + ("." + names if names else "") + ("#" + _NUMBERS.sub("0", attrs["id"]) if attrs.get("id") else "")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """A tag's attributes, the place behind it (-1 where the text ends before it does), and whether a slash closes it."""
    attrs: dict[str, str] = {}
    while m := _ATTR.match(html, at):
        at = m.end()
        if m[1]:
            return attrs, at, html[at - 2] == "/"
        value = m[3] or m[4] or m[5] or ""
        attrs.setdefault(m[2].lower(), unescape(value) if "&" in value else value)
    return attrs, -1, False


def parse(html: str) -> Node:
    """A tree of elements and strings; open ends, missing ends and cut pages are accepted as browsers do."""
    root = Node("html", {})
    stack, places = [root], {"html": [0]}

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def text(s: str) -> None:
        if stack[-1].tag == "head" and not s.isspace():
            close(len(stack) - 1)
        stack[-1].children.append(unescape(s) if "&" in s else s)

    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin != at:
            begin = n if begin < 0 else begin
            text(html[at:begin])
            at = begin
            continue
        ending = html.startswith("/", at + 1)
        m = _NAME.match(html, at + 1 + ending)
        if not m:
            if html.startswith("<!--", at):
                at = _COMMENT.match(html, at).end()
            elif html[at + 1 : at + 2] in ("!", "?") or (ending and at + 2 < n):
                at = html.find(">", at) + 1 or n
            else:
                text("<")
                at += 1
            continue
        tag = m[0].lower()
        attrs, at, slash = _attributes(html, m.end())
        if at < 0:
            break
        if ending:
            if places.get(tag) and tag not in ("html", "body"):
                close(places[tag][-1])
            continue
        if tag in ("html", "body", "head") and places.get(tag):
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in ENDS:
            ended, bounds = (max((places[t][-1] for t in some if places.get(t)), default=0) for some in ENDS[tag])
            if ended > bounds:
                close(ended)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            if tag not in SILENT:
                node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (slash and tag not in BLOCK):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def _named_aside(node: Node, inner: bool) -> bool:
    """Whether tag, role, class or id say that a node isn't the article's text."""
    attrs = node.attrs
    if node.tag in ASIDE_TAGS or (node.tag == "header" and not inner):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ASIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    words = set(_SPLIT.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    words = words - INNER_OK if inner else words
    return not words.isdisjoint(ASIDE_WORDS) and node.tag not in ("html", "body", "article", "main") or (node.tag == "article" and not words.isdisjoint({"comment", "comments", "reply", "ad", "advert", "promo", "related"}))


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main" or node.attrs.get("itemprop") == "articleBody"


# ---- folded trees ----


class Tree:
    """A page's elements that aren't within a line, by number, in page order; number 0 is the root.

    Neighbours of the same mark and shape (paragraphs, items of a list) are folded: `canon` gives for each element the
    first of its run, and `children` the folded children of those.
    """

    def __init__(self, root: Node):
        self.marks, self.parent, self.aside, self.main, self.heading = [root.mark], [-1], [False], [False], [False]
        #: Strings and bounds of blocks in page order: (element, string, in a link), a string None for a bound.
        self.texts: list[tuple[int, str | None, bool]] = []
        below: list[list[int]] = [[]]
        stack: list[tuple[Iterator, int, bool, bool, bool]] = [(iter(root.children), 0, False, False, False)]
        while stack:
            rest, number, inner, link, block = stack[-1]
            for c in rest:
                if isinstance(c, str):
                    self.texts.append((number, c, link))
                elif c.tag not in SILENT:
                    main = _is_main(c)
                    aside = _named_aside(c, inner or main)
                    apart = c.tag in BLOCK or c.tag == "br"
                    if apart:
                        self.texts.append((number, None, False))
                    to = number
                    if c.tag not in INLINE or aside:
                        to = len(self.marks)
                        below[number].append(to)
                        below.append([])
                        self.marks.append(c.mark)
                        self.parent.append(number)
                        self.aside.append(aside)
                        self.main.append(main and not aside)
                        self.heading.append(c.tag in HEADINGS)
                    stack.append((iter(c.children), to, inner or main, link or c.tag == "a", apart))
                    break
            else:
                stack.pop()
                if block:
                    self.texts.append((number, None, False))
        self._fold(below)

    def _fold(self, below: list[list[int]]) -> None:
        n = len(self.marks)
        self.canon, self.children, shapes = list(range(n)), below, [0] * n
        for x in range(n - 1, -1, -1):
            kept: list[int] = []
            for c in below[x]:
                if kept and shapes[kept[-1]] == shapes[c]:
                    same = [(kept[-1], c)]
                    while same:
                        first, other = same.pop()
                        self.canon[other] = first
                        same += zip(below[first], below[other])
                else:
                    kept.append(c)
            below[x] = kept
            shapes[x] = xxhash.xxh64_intdigest(f"{self.marks[x]}\0{[shapes[c] for c in kept]}")
        self.shape = shapes[0]
        for x in range(n):
            # The first of a run may itself be in a copy of another run, of a smaller number.
            self.canon[x] = self.canon[self.canon[x]]


def tree_match(a_marks: list[str], a_below: list[list[int]], b_marks: list[str], b_below: list[list[int]], limit: int | None = None) -> dict[int, int]:
    """The simple tree matching of two trees whose roots have number 0, from numbers of the first to those of the second.

    Roots match, matched children keep their order, and no matching has more nodes. Up to `limit` pairs of nodes each has its own size;
    beyond, pairs of equal subtrees share one, and rows of children that begin or end alike aren't tabled there.
    """
    if a_marks[0] != b_marks[0]:
        return {}
    limit = PAIRS if limit is None else limit
    order, cells = [(0, 0)], 0
    for a, b in order:
        cells += len(a_below[a]) * len(b_below[b])
        if cells > limit:
            return _match_by_shape(a_marks, a_below, b_marks, b_below)
        if a_below[a]:
            named: dict[str, list[int]] = {}
            for y in b_below[b]:
                named.setdefault(b_marks[y], []).append(y)
            order += [(x, y) for x in a_below[a] for y in named.get(a_marks[x], ())]
    size: dict[tuple[int, int], int] = {}
    for a, b in reversed(order):
        size[a, b] = 1 + (_table(a_below[a], b_below[b], size)[-1][-1] if a_below[a] and b_below[b] else 0)
    found, open_ = {}, [(0, 0)]
    while open_:
        a, b = open_.pop()
        found[a] = b
        xs, ys = a_below[a], b_below[b]
        if not xs or not ys:
            continue
        table, i, j = _table(xs, ys, size), len(xs), len(ys)
        while i and j:
            pair = xs[i - 1], ys[j - 1]
            if pair in size and table[i][j] == table[i - 1][j - 1] + size[pair]:
                open_.append(pair)
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return found


def _table(xs: list[int], ys: list[int], size: dict[tuple[int, int], int]) -> list[list[int]]:
    """Largest matchings of all beginnings of two rows of children."""
    if len(ys) >= WIDE:
        rows = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i, x in enumerate(xs):
            np.maximum(rows[i, 1:], rows[i, :-1] + [size.get((x, y), 0) for y in ys], out=rows[i + 1, 1:])
            np.maximum.accumulate(rows[i + 1], out=rows[i + 1])
        return rows.tolist()
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = table[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(last[j + 1], row[j], last[j] + size.get((x, y), 0)))
        table.append(row)
    return table


def _match_by_shape(a_marks: list[str], a_below: list[list[int]], b_marks: list[str], b_below: list[list[int]]) -> dict[int, int]:
    """tree_match() of large trees: sizes are those of pairs of shapes, and a row of a table is kept only so often that the others can be made again."""
    kinds: dict[tuple, int] = {}
    of_kind: list[tuple] = []

    def shapes(marks: list[str], below: list[list[int]]) -> list[int]:
        out, order = [0] * len(marks), [0]
        for x in order:
            order += below[x]
        for x in reversed(order):
            key = marks[x], tuple(out[c] for c in below[x])
            if key not in kinds:
                kinds[key] = len(of_kind)
                of_kind.append(key)
            out[x] = kinds[key]
        return out

    a_shape, b_shape = shapes(a_marks, a_below), shapes(b_marks, b_below)
    whole: list[int] = []
    for _, kids in of_kind:
        whole.append(1 + sum(whole[k] for k in kids))
    size: dict[tuple[int, int], int] = {}

    def known(p: int, q: int) -> int | None:
        """The size of the matching of two shapes; null where it isn't known yet."""
        if of_kind[p][0] != of_kind[q][0]:
            return 0
        if p == q:
            return whole[p]
        return size.get((p, q)) if of_kind[p][1] and of_kind[q][1] else 1

    def ends(xs: tuple, ys: tuple) -> tuple[int, int]:
        """How many equal subtrees two rows begin and end with: a largest matching has them."""
        n = min(len(xs), len(ys))
        head = next((i for i in range(n) if xs[i] != ys[i]), n)
        return head, next((i for i in range(n - head) if xs[-1 - i] != ys[-1 - i]), n - head)

    def step(last: np.ndarray, x: int, columns: dict[str, list[tuple[int, int]]], places: np.ndarray) -> np.ndarray:
        """The next row of a table, for a further child x."""
        alike = columns.get(of_kind[x][0])
        if not alike:
            return last
        sizes = np.zeros(int(places.max()) + 1, np.int64)
        for k, q in alike:
            sizes[k] = known(x, q)
        row = last.copy()
        np.maximum(last[1:], last[:-1] + sizes[places], out=row[1:])
        return np.maximum.accumulate(row)

    def columns_of(ys: tuple) -> tuple[dict[str, list[tuple[int, int]]], np.ndarray]:
        """The different shapes of a row, by mark and with their numbers, and the number at each of its places."""
        different, places = np.unique(np.array(ys, np.int64), return_inverse=True)
        columns: dict[str, list[tuple[int, int]]] = {}
        for k, q in enumerate(different.tolist()):
            columns.setdefault(of_kind[q][0], []).append((k, q))
        return columns, places

    open_: list[tuple[int, int]] = [(a_shape[0], b_shape[0])]
    while open_:
        p, q = open_[-1]
        if known(p, q) is not None:
            open_.pop()
            continue
        xs, ys = of_kind[p][1], of_kind[q][1]
        head, tail = ends(xs, ys)
        left, right = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        by_mark: dict[str, list[int]] = {}
        for y in set(right):
            by_mark.setdefault(of_kind[y][0], []).append(y)
        needed = [(x, y) for x in set(left) for y in by_mark.get(of_kind[x][0], ()) if known(x, y) is None]
        if needed:
            open_ += needed
            continue
        last = np.zeros(len(right) + 1, np.int64)
        if left and right:
            columns, places = columns_of(right)
            for x in left:
                last = step(last, x, columns, places)
        size[p, q] = 1 + int(last[-1]) + sum(whole[x] for x in (*xs[:head], *xs[len(xs) - tail :]))

    found, met = {}, [(0, 0)]
    while met:
        a, b = met.pop()
        found[a] = b
        xs, ys = a_below[a], b_below[b]
        left, right = tuple(a_shape[x] for x in xs), tuple(b_shape[y] for y in ys)
        head, tail = ends(left, right)
        met += [*zip(xs[:head], ys[:head]), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :])]
        left, right = left[head : len(xs) - tail], right[head : len(ys) - tail]
        if not left or not right:
            continue
        columns, places = columns_of(right)
        often = int(len(left) ** 0.5) + 1
        kept = [np.zeros(len(right) + 1, np.int64)]
        row = kept[0]
        for i, x in enumerate(left):
            row = step(row, x, columns, places)
            if (i + 1) % often == 0:
                kept.append(row)
        i, j, block, rows = len(left), len(right), -1, []
        while i and j:
            if (i - 1) // often != block:
                block = (i - 1) // often
                rows = [kept[block]]
                for x in left[block * often : (block + 1) * often]:
                    rows.append(step(rows[-1], x, columns, places))
            now, last = rows[i - block * often], rows[i - block * often - 1]
            more = known(left[i - 1], right[j - 1])
            if more and now[j] == last[j - 1] + more:
                met.append((xs[head + i - 1], ys[head + j - 1]))
                i, j = i - 1, j - 1
            elif now[j] == last[j]:
                i -= 1
            else:
                j -= 1
    return found


# ---- wrappers ----


def folded(html: str) -> dict:
    """A page's folded tree, parents before children: marks, parents, and of how many pages (one) each node was seen, is aside, main and a heading."""
    tree = Tree(parse(html))
    first = [x for x, c in enumerate(tree.canon) if x == c]
    rank = {x: k for k, x in enumerate(first)} | {-1: -1}
    out: dict[str, list] = {"marks": [tree.marks[x] for x in first], "parents": [rank[tree.parent[x]] for x in first], "seen": [1] * len(first)}
    return out | {what: [int(flag[x]) for x in first] for what, flag in zip(FLAGS, (tree.aside, tree.main, tree.heading))}


#: What is counted of a node besides the pages that have it.
FLAGS = ("aside", "main", "heading")


def children(parents: list[int]) -> list[list[int]]:
    below: list[list[int]] = [[] for _ in parents]
    for x, p in enumerate(parents):
        if p >= 0:
            below[p].append(x)
    return below


def paths(tree: dict) -> list[int]:
    """For each node a digest of the marks from the root to it. Nodes that match have the same."""
    out: list[int] = []
    for mark, p in zip(tree["marks"], tree["parents"]):
        out.append(xxhash.xxh64_intdigest(f"{out[p] if p >= 0 else ''}\0{mark}") - (1 << 63))
    return out


def without(tree: dict, keep: list[bool]) -> dict:
    """A tree's nodes to be kept; none is below one that isn't."""
    rank, kept = {-1: -1}, [x for x, k in enumerate(keep) if k]
    rank |= {x: k for k, x in enumerate(kept)}
    return {key: [rank[values[x]] if key == "parents" else values[x] for x in kept] for key, values in tree.items()}


def merged(trees: list[tuple[dict, int]]) -> dict:
    """One tree with the nodes of all of (tree, pages that have it), and over how many pages each was seen.

    Trees are matched one after the other to the tree so far, and what doesn't match is added where it stands.
    """
    marks, below = [trees[0][0]["marks"][0]], [[]]
    counts: dict[str, list[int]] = {key: [0] for key in ("seen", *FLAGS)}

    def add(mark: str) -> int:
        marks.append(mark)
        below.append([])
        for values in counts.values():
            values.append(0)
        return len(marks) - 1

    for tree, pages in trees:
        theirs = children(tree["parents"])
        found = tree_match(tree["marks"], theirs, marks, below)
        open_ = [(0, 0)]
        while open_:
            x, r = open_.pop()
            for key, values in counts.items():
                values[r] += tree[key][x] * pages
            place = {c: i for i, c in enumerate(below[r])}
            row, done = [], 0
            for c in theirs[x]:
                if c in found:
                    to = place[found[c]]
                    row += below[r][done : to + 1]
                    done = to + 1
                    open_.append((c, found[c]))
                else:
                    row.append(add(tree["marks"][c]))
                    open_.append((c, row[-1]))
            below[r] = row + below[r][done:]
    order, parents, open_ = [], [], [(0, -1)]
    while open_:
        r, parent = open_.pop()
        open_ += [(c, len(order)) for c in reversed(below[r])]
        order.append(r)
        parents.append(parent)
    return {"marks": [marks[r] for r in order], "parents": parents} | {key: [values[r] for r in order] for key, values in counts.items()}


def flagged(tree: dict) -> dict:
    """The reference tree of a merged tree: what most pages that have a node say it is."""
    flags = [sum((2 * tree[what][x] > n) << bit for bit, what in enumerate(FLAGS)) for x, n in enumerate(tree["seen"])]
    return {"marks": tree["marks"], "parents": tree["parents"], "flags": flags}


def pruned(tree: dict, lone: set[int]) -> dict:
    """A tree without the nodes whose path of marks no other page of the host has."""
    return without(tree, [p not in lone for p in paths(tree)])


def reference(pages: list[str]) -> dict | None:
    """The reference tree of different pages of a host; below FEWEST of them nothing is known."""
    trees = [folded(h) for h in dict.fromkeys(pages)]
    if len(trees) < FEWEST:
        return None
    held = Counter(p for t in trees for p in set(paths(t)))
    return flagged(merged([(pruned(t, {p for p, n in held.items() if n == 1}), 1) for t in trees]))


class Wrapper:
    """A reference tree, and once statistics are known what of its nodes is content."""

    def __init__(self, text: str):
        known = json.loads(text)
        self.tree = tree = known["tree"] if isinstance(known["tree"], dict) else json.loads(known["tree"])
        self.marks, self.parents = tree["marks"], tree["parents"]
        self.below = children(self.parents)
        self.aside, self.main, self.heading = ([bool(f & bit) for f in tree["flags"]] for bit in (1, 2, 4))
        self.alike: dict[int, list[int]] = {}
        self.content: int | None = known.get("content")
        if known.get("nodes"):
            self._decide({s["node"]: s for s in known["nodes"]})
        elif self.content is not None:
            self.slots, self.own, self.rest = set(known["slots"]), *([bit == "1" for bit in known[key]] for key in ("own", "rest"))

    def decided(self) -> str | None:
        """The wrapper with what was decided in place of the statistics; None where no node is content."""
        bits = {key: "".join("01"[b] for b in flags) for key, flags in (("own", self.own), ("rest", self.rest))} if self.content is not None else {}
        return json.dumps({"tree": self.tree, "content": self.content, "slots": sorted(self.slots)} | bits) if bits else None

    def bound(self, tree: Tree, to: list[int]) -> int | None:
        """The node that bounds a page's content; None where the page has none.

        Where the host's content names itself, a page without it in which nothing else names itself so is bounded by the root, if it has slots.
        """
        if self.content in to:
            return self.content
        return 0 if self.main[self.content] and not any(tree.main) and not self.slots.isdisjoint(to) else None

    def aligned(self, tree: Tree) -> list[int]:
        """For each element of a page the reference node that it aligns with, or -1; pages of one shape are aligned once."""
        first = [x for x, c in enumerate(tree.canon) if x == c]
        rank = {x: k for k, x in enumerate(first)}
        if tree.shape not in self.alike:
            if len(self.alike) > 500:
                self.alike.clear()
            found = tree_match(tree.marks, tree.children, self.marks, self.below)
            self.alike[tree.shape] = [found.get(x, -1) for x in first]
        to = self.alike[tree.shape]
        return [to[rank[c]] for c in tree.canon]

    def _decide(self, nodes: dict[int, dict]) -> None:
        n = len(self.marks)
        aside, within = list(self.aside), [-1] * n
        for x in range(n):
            p = self.parents[x]
            aside[x] = aside[x] or (p >= 0 and aside[p])
            within[x] = x if self.main[x] else within[p] if p >= 0 else -1
        live = [x for x in nodes if not aside[x]]
        if not live:
            return
        lead = max(live, key=lambda x: (nodes[x]["mass"], -x))
        share = lambda x, what: nodes[x][what] / nodes[x]["pages"]
        # Whole pages that come back make every node come back: what counts is how much more than the main slot it does.
        same, back = SAME + (1 - SAME) * share(lead, "top"), 0.5 + 0.5 * share(lead, "back")

        def template(x: int) -> bool:
            if x == lead:
                return False
            if nodes[x]["pages"] >= FEWEST and share(x, "top") >= same:
                return True
            if self.heading[x] or within[x] >= 0:
                return False
            # Two pages with the same text may be copies: they only count where the host has hardly more.
            told = nodes[x]["pages"] >= FEWEST or nodes[x]["pages"] * FEWEST >= nodes[lead]["pages"]
            return (told and share(x, "back") > back) or share(x, "begin") >= same or nodes[x]["linked"] > LINKED * nodes[x]["mass"]

        self.slots = slots = {x for x in live if not template(x)}
        self.content = within[lead] if within[lead] >= 0 else self._lowest(slots)
        #: Whether a node's own text is content, and whether what is found below it and isn't aligned is.
        self.own, self.rest = [False] * n, [False] * n
        holds, judged = set(), set()
        for x in range(n - 1, -1, -1):
            p = self.parents[x]
            if x in slots or x in holds:
                holds |= {x, p}
            if x in judged or x in nodes or aside[x]:
                judged.add(p)
        for x in range(n):
            inherited = self.rest[self.parents[x]] if x != self.content and self.parents[x] >= 0 else x == self.content
            self.rest[x] = not aside[x] and (x in holds or (inherited and x not in nodes and x not in judged))
            self.own[x] = x in slots or (x not in nodes and self.rest[x])

    def _lowest(self, slots: set[int]) -> int:
        """The lowest node that holds all slots."""
        left = dict.fromkeys(range(len(self.marks)), 0)
        for x in slots:
            left[x] = 1
        for x in range(len(self.marks) - 1, 0, -1):
            left[self.parents[x]] += left[x]
        return max(x for x, k in left.items() if k == len(slots))


_wrapper = lru_cache(maxsize=256)(Wrapper)


def slot_texts(html: str, wrapper: str | None) -> list[tuple[int, bool, int, int, int]]:
    """What a page holds in the nodes of its host's reference tree: (node, whole, digest, length, length in links), of the whole text and of how it begins."""
    if wrapper is None:
        return []
    tree = Tree(parse(html))
    to = _wrapper(wrapper).aligned(tree)
    parts: dict[int, list[str]] = {}
    linked: dict[int, int] = {}
    for x, s, link in tree.texts:
        if to[x] >= 0:
            parts.setdefault(to[x], []).append(" " if s is None else s)
            if link and s:
                linked[to[x]] = linked.get(to[x], 0) + len("".join(s.split()))
    out = []
    for r, strings in parts.items():
        words = "".join(strings).split()
        if words:
            out.append((r, True, xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), sum(map(len, words)), linked.get(r, 0)))
            if len(words) > BEGIN:
                out.append((r, False, xxhash.xxh64_intdigest(" ".join(words[:BEGIN])) - (1 << 63), 0, 0))
    return out


def extract(html: str, wrapper: str | None = None) -> str:
    """The main text: that of the wrapper's slots, or where it has none or isn't met, of what elements name themselves."""
    tree = Tree(parse(html))
    known = _wrapper(wrapper) if wrapper is not None else None
    own = _by_alignment(tree, known) if known and known.content is not None else None
    own = own or _by_names(tree)
    return " ".join("".join(" " if s is None else s for x, s, _ in tree.texts if s is None or own[x]).split())


def _by_alignment(tree: Tree, wrapper: Wrapper) -> list[bool] | None:
    """For each element whether its own text is content; None where the page has no such place."""
    to = wrapper.aligned(tree)
    bound = wrapper.bound(tree, to)
    if bound is None:
        return None
    n = len(tree.marks)
    inside, rest, own = [False] * n, [False] * n, [False] * n
    for x in range(n):
        p, r = tree.parent[x], to[x]
        inside[x] = r == bound or (p >= 0 and inside[p])
        if tree.aside[x] or (p >= 0 and inside[p] and not inside[x]):
            inside[x] = False
        if inside[x]:
            own[x], rest[x] = (wrapper.own[r], wrapper.rest[r]) if r >= 0 else (rest[p], rest[p])
    return own


def _by_names(tree: Tree) -> list[bool]:
    """Elements that name themselves the content, or else all, without those that name themselves something else."""
    n = len(tree.marks)
    out = [False] * n
    for x in range(n):
        p = tree.parent[x]
        out[x] = p >= 0 and out[p] or tree.aside[x]
    held = [False] * n
    for x in range(n):
        held[x] = not out[x] and (tree.main[x] or (tree.parent[x] >= 0 and held[tree.parent[x]]))
    return held if any(held) else [not o for o in out]


# ---- over tables ----


def reference_trees(pages: DataFrame) -> DataFrame:
    """(host, tree) of rows (host, html): the folded trees of all different pages of each host of FEWEST or more, merged.

    Pages of the same tree are one with their number. Nodes whose path of marks no other page of the host has can't match
    any, so they go first, and all others are in the reference tree. They are merged some FAN trees at a time, their results again, until one of each host is left.
    """
    shape = F.xxhash64("tree")
    rows = pages.select("host", "html", F.xxhash64("html").alias("page"))
    folds = map_texts(rows, "html", lambda: lambda html: {"tree": [json.dumps(folded(h)) for h in html]}, "tree string")
    folds = stored(folds.withColumn("shape", shape), "folds")
    number = stored(folds.select("host", "shape", "page").distinct().groupBy("host", "shape").agg(F.count("*").alias("n")), "numbers")
    hosts = number.groupBy("host").agg(F.sum("n").alias("different")).where(F.col("different") >= FEWEST).select("host")
    trees = folds.groupBy("host", "shape").agg(F.first("tree").alias("tree"))
    trees = stored(trees.join(number.join(few(hosts), "host"), ["host", "shape"]), "trees")

    held = map_texts(trees, "tree", lambda: lambda trees: {"paths": [sorted(set(paths(json.loads(t)))) for t in trees]}, "paths array<long>")
    held = held.select("host", "shape", "n", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.sum("n").alias("n"), F.first("shape").alias("shape"))
    lone = held.where("n = 1").groupBy("host", "shape").agg(F.collect_list("path").alias("lone"))

    kept = map_texts(trees.join(lone, ["host", "shape"], "left"), "tree", lambda: lambda trees, lone: {"kept": [json.dumps(pruned(json.loads(t), set(gone))) if gone else t for t, gone in zip(trees, lone)]}, "kept string", also=("lone",))
    kept = kept.select("host", "n", F.col("kept").alias("tree")).groupBy("host", shape.alias("shape")).agg(F.first("tree").alias("tree"), F.sum("n").alias("n"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "shape"], ascending=[False, True])
        tree = merged([(json.loads(t), int(n)) for t, n in zip(rows["tree"], rows["n"])])
        return pd.DataFrame({"host": rows["host"].iloc[:1].to_list(), "shape": rows["group"].iloc[:1].to_list(), "tree": [json.dumps(tree)], "n": [1]})

    # What is merged counts its pages itself, and its number is that of the group it was.
    parts, most = stored(kept, "parts"), 0
    while most != 1:
        groups = parts.groupBy("host").agg(F.ceil(F.least(F.count("*") / 2, F.greatest(F.count("*") / FAN, F.sum(F.length("tree")) / FAN_CHARS))).alias("groups"))
        most = groups.agg(F.max("groups")).first()[0] or 1
        parts = parts.join(few(groups), "host").withColumn("group", F.pmod("shape", "groups"))
        parts = stored(parts.groupBy("host", "group").applyInPandas(merge, "host string, shape long, tree string, n long"), "parts")
    return map_texts(parts.select("host", F.col("tree").alias("all")), "all", lambda: lambda trees: {"tree": [json.dumps(flagged(json.loads(t))) for t in trees]}, "tree string")


def _with_wrapper(rows: DataFrame, wrappers: DataFrame, added: str, of: Callable[[str, str | None], object]) -> DataFrame:
    """rows with the column `added` (a name and a type) that of(html, wrapper) makes, None for no page, in place of html.

    A host may hold a third of the rows, and wrappers may be long. Where they are too large to be broadcast and repeated in
    rows, hosts are dealt to SALT parts, and each begins with the wrapper.
    """
    total, longest = wrappers.agg(F.sum(F.length("wrapper")), F.max(F.length("wrapper"))).first()
    if (total or 0) <= BROADCAST_CHARS and (longest or 0) <= LONG:
        dealt = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALT)).cast("int"))
        first = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = salted.unionByName(first, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull()).drop("salt")
    name = added.split()[0]

    def make():
        known: list = [None, None]

        def run(pages: list, hosts: list, wrappers: list) -> dict:
            out = []
            for html, host, wrapper in zip(pages, hosts, wrappers):
                if wrapper is not None or host != known[0]:
                    known[:] = host, wrapper
                out.append(None if html is None else of(html, known[1]))
            return {name: out}

        return run

    return map_texts(dealt.withColumn("of", F.col("host")), "html", make, added, also=("of", "wrapper")).where(F.col(name).isNotNull())


def induce_wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper) of rows (host, key, url, html): reference trees, and what their nodes hold over all pages of the host.

    Of a node are counted the pages that have text in it, the most that have the same text and the most whose text begins
    alike, those whose text comes back anywhere in the table, the length of its different texts, and how much of that is in links.
    """
    trees = stored(reference_trees(rows), "references")
    wrappers = trees.select("host", F.to_json(F.struct("tree")).alias("wrapper"))
    names = ("node", "whole", "digest", "length", "linked")
    own = _with_wrapper(rows, wrappers, "own array<struct<node:int,whole:boolean,digest:long,length:long,linked:long>>", lambda html, wrapper: [dict(zip(names, s)) for s in slot_texts(html, wrapper)])
    texts = own.select("host", F.explode("own").alias("o")).groupBy("host", "o.node", "o.whole", "o.digest").agg(F.count("*").alias("n"), F.max("o.length").alias("length"), F.max("o.linked").alias("linked"))
    texts = stored(texts, "slots")
    back = stored(texts.where("whole").groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1").select("digest", F.lit(True).alias("whole"), F.lit(True).alias("back")), "back")
    whole = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(0)
    nodes = texts.join(back, ["digest", "whole"], "left").groupBy("host", "node").agg(
        F.sum(whole("n")).alias("pages"), F.max(whole("n")).alias("top"), F.max(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("begin"),
        F.sum(F.when(F.col("back"), F.col("n")).otherwise(0)).alias("back"), F.sum("length").alias("mass"), F.sum("linked").alias("linked"),
    )
    nodes = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "top", "begin", "back", "mass", "linked"))).alias("nodes"))
    counted = trees.join(nodes, "host", "left").select("host", F.to_json(F.struct("tree", "nodes")).alias("counted"))
    return map_texts(counted, "counted", lambda: lambda counted: {"wrapper": [Wrapper(c).decided() for c in counted]}, "wrapper string").where("wrapper is not null")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text.

    Null html counts as empty and has an empty text; a null or odd url belongs to the host ''. Hosts with under
    FEWEST different pages have no wrapper, and their pages, like those that lack their host's content node, are
    read by what elements name themselves. Long and deep pages are read whole. Pages that repeat get the same text,
    and so do null and repeated ids; of slots with equally much text the first leads. Other columns are ignored,
    whatever their names. No rows give no rows.
    """
    rows = columns(pages, id_col, url_col, html_col).toDF("key", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))
    found = _with_wrapper(rows, stored(induce_wrappers(rows), "wrappers"), "text string", extract)
    return found.select("key", "url", "text").toDF(id_col, url_col, "text")
