"""Main text of pages by wrapper induction.

A wrapper is what pages of one host and layout share. A page's layout is the set of its structural elements (tags and
class tokens, digits aside). Of every layout of a host the ``REFERENCES`` distinct pages with the least hashes are
references. Every page of the layout is aligned with each of them by simple tree matching (the largest order- and
root-preserving match of two trees, a dynamic program over child lists; of equally large ones, that with more equal
names and texts), and votes on the reference's nodes; votes are summed over all pages, combined before the shuffle.

* A reference's node is *template* where enough pages have the same text at it: ``CONSTANT`` of those aligned, or
  ``REPEATED`` of all for texts of ``PHRASE`` words or more (a notice that only some pages show). At least ``MIN_VOTES``
  pages must agree. Headings inside an article or main element are labels of what follows and stay.
* It is a *menu* where, over all aligned pages, most of its text is in links, outside of articles.
* What is aligned with neither, or with a template node but has another text, is a slot, and varying slots are content.

Pages that share over half of their text with a reference are copies of it and do not vote.

A page is read with the wrapper of its layout: what is aligned with a template node and has its text goes, and what
is aligned with a menu and is mostly links. Roles that are never content settle what no vote tells, by tag, or by whole
class tokens: nav, header and footer of the page, aside and sidebars, forms, cookie and other notices, adverts, comments
of readers, scripts, styles and the head. Where there are article or main elements, the slots in all of them are the
text; where there are none, all slots.

References are a bounded sample of each layout; every page votes, and every page is read whole. Where all
references are under ``BROADCAST_BYTES`` they are broadcast, else joined by host and layout. Child lists of any length
are aligned whole; of over ``CELLS`` pairs the same table is made by array operations, a row at a time, and few rows are kept.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a newline in page order, empty ones left out. Block-level elements and ``br`` end a block.

Defined results: null and empty html, and pages without any main text, give an empty text; an unclosed or
cut-off page is read as far as it goes; a null or odd url is of a host of its own kind ('') with no wrapper; pages of
layouts with fewer than ``MIN_VOTES`` + 1 different pages have no votes and are read by roles alone; very long and very
deep pages are read whole; repeated rows are read each; an empty table gives an empty result; other columns do not enter.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut

REFERENCES, MIN_VOTES, CONSTANT, REPEATED, PHRASE = 3, 2, 0.8, 0.25, 5
#: Share of text in links that makes a menu.
LINKED = 0.6
#: Pairs of children up to which a whole table of two lists is held; the way beyond gives the same pairs.
CELLS = 40_000
#: Parts that rows are cut into, again and again, to find the pairs of longer lists.
PARTS = 16
BROADCAST_BYTES = 32_000_000
#: References up to which their keys are broadcast to fetch the pages.
KEY_ROWS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that an opening tag closes, and those that stop the search for one.
CLOSES = {t: frozenset({"p"}) for t in BLOCKS - {"br", "body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}}
CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}
FORMATTING = frozenset("a b big code em font i s small span strike strong sub sup tt u mark abbr cite q label".split())
DROPPED_TAGS = frozenset("head nav aside form button select input textarea script style noscript template iframe svg object canvas dialog menu footer".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: What takes no part in an alignment.
SKIPPED = frozenset("script style noscript template br img".split())
#: Names of roles: a class token of this name, or one that begins or ends with it before or after a hyphen.
DROPPED_NAMES = frozenset(
    "ad ads adbox adunit adslot adbanner advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer copyright sidebar "
    "cookie cookies cookiebar consent gdpr newsletter comments commentlist disqus pagination pager popup modal skiplink".split()
)
#: Names that say it only as a whole token, for inside another they may be a topic.
DROPPED_TOKENS = frozenset(
    "banner promo promotion aside side-bar related recommended recommendations widget widgets social share sharing subscribe signup login notice notices overlay alert "
    "comment respond reply replies discussion tag tags toolbar skip-link post-tags entry-tags related-posts share-buttons social-share".split()
)
#: Names that inside an article may be those of its parts: prose under them stays.
DOUBTFUL = frozenset("related recommended recommendations notice notices share sharing social navigation menu alert tag tags widget widgets overlay banner toolbar".split())
#: What else a name of a role is made of; with other words it may be a topic.
STRUCTURAL = frozenset(
    "area bar block body bottom box btn button col container content desktop fixed form global header image inner item items label large left link links list main mobile module "
    "nav menu outer page panel post primary right row secondary section site slot small sticky text title top unit wrap wrapper widget".split()
)
#: Names, besides forms, that a template may give to what holds the whole page.
HOLDERS = frozenset("nav navbar navigation menu banner overlay modal popup widget widgets toolbar sidebar side-bar aside notice alert promo login signup consent".split())
#: Characters of text from which such a holder may be most of a page.
MOST = 150
#: Tokens that inside an article may be a part of it.
PART_TOKENS = frozenset({"discussion"})
HEADER_NAMES = frozenset("header masthead".split())
#: An article of such a name is a reader's, an advert or a teaser.
ASIDE_NAMES = frozenset("comment comments reply replies respond ad ads advert advertisement sponsor sponsored promo related recommended teaser teasers widget".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    # a quote opens a value only after an equals sign
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=(?!\s*[\"']))*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass(slots=True)
class Node:
    tag: str  # '' for text
    name: str = ""  # class, id and role
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""
    hidden: bool = False
    elements: list[Node] | None = None  # children that take part in an alignment
    at: tuple[int, int] = (0, 0)  # first and end of its texts among those of the page
    number: int = -1
    key: int = 0  # equal for equal texts, whatever the markup; 0 for none
    holds: bool = False  # a main element, or an article that is no reader's, advert or teaser, is below


def parse(html: str) -> Node:
    """Tree of elements and texts; what is not closed ends where its parent does, formatting does not outlive its block."""
    root = at = Node("")
    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None or m.start() > pos:
            text = html[pos : m.start() if m else n]
            at.children.append(Node("", parent=at, text=text))
        if m is None:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                if node.tag in BLOCKS and tag in FORMATTING:  # a stray end of formatting does not close a block
                    node = root
                    break
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in CLOSES:
            node, stop = at, SCOPES.get(tag, frozenset())
            # only what is open below the nearest block that is not itself closed by this tag
            while node.parent is not None and node.tag not in stop and (node.tag in FORMATTING or node.tag in CLOSES[tag]):
                if node.tag in CLOSES[tag]:
                    at = node.parent
                node = node.parent
        attributes = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        name = " ".join(attributes[k] for k in ("class", "id") if k in attributes)
        node = Node(tag, name, at)
        if attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in m[3].split() or attributes.get("aria-hidden") == "true":
            node.hidden = True
        at.children.append(node)
        if tag == "main" or tag == "article" and not (name and _named(name, True, False)):
            while at is not None and not at.holds:
                at.holds, at = True, at.parent
            at = node.parent
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I).search(html, pos)
            node.children.append(Node("", parent=node, text=html[pos : end.start() if end else n]))
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node
    return root


SURE, DOUBT, TOPIC = 1, 2, 3


@lru_cache(maxsize=10_000)
def _named(name: str, article: bool, inside: bool) -> int:
    """Whether a class and id name a role that is never content: 0, surely, by a doubtful name, or beside words that may be a topic."""
    found = set()
    for token in name.lower().replace("_", "-").split():
        parts = token.split("-")
        if article:
            if token in ASIDE_NAMES or parts[-1] in ASIDE_NAMES:
                return SURE
        elif token in DROPPED_NAMES:
            found.add(DOUBT if token in DOUBTFUL else SURE)
        elif parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES:
            role, rest = (parts[0], parts[1:]) if parts[0] in DROPPED_NAMES else (parts[-1], parts[:-1])
            plain = all(x in STRUCTURAL or x in DROPPED_NAMES or x in DROPPED_TOKENS or not x.strip("0123456789") for x in rest)
            found.add(TOPIC if not plain else DOUBT if role in DOUBTFUL else SURE)
        elif token in DROPPED_TOKENS and not (inside and token in PART_TOKENS):
            found.add(DOUBT if token in DOUBTFUL else SURE)
    return min(found, default=0)


def _holder(name: str) -> bool:
    tokens = name.lower().replace("_", "-").split()
    return any(t in HOLDERS or t.split("-")[0] in HOLDERS for t in tokens) and not any(t.split("-")[0] in ASIDE_NAMES for t in tokens)


def _measure(node: Node, skip: frozenset[str] = frozenset()) -> tuple[int, int, int, int]:
    """Words, words in links, characters and sentence marks below a node, without elements of the tags in ``skip``."""
    words = linked = chars = marks = 0
    stack = [(node, False)]
    while stack:
        x, link = stack.pop()
        if x.tag or x.parent is None:
            stack.extend((c, link or x.tag == "a") for c in x.children if c.tag not in skip)
        elif own := x.text.split():
            words, linked, chars = words + len(own), linked + len(own) * link, chars + sum(map(len, own))
            marks += sum(w[-1] in ".!?" for w in own)
    return words, linked, chars, marks


def _most(node: Node) -> bool:
    """Whether a node has most of the page's text."""
    own = _measure(node, DROPPED_TAGS - {"form"})
    if own[2] < MOST:
        return False
    root = node
    while root.parent is not None:
        root = root.parent
    return 2 * own[2] > _measure(root, DROPPED_TAGS - {"form"})[2]


def _part_of_article(node: Node, level: int) -> bool:
    """Whether what a doubtful name stands for reads like a part of the article around it."""
    words, linked, _, marks = _measure(node)
    if level == TOPIC:
        return linked < LINKED * words
    return words >= 8 and marks > 0 and linked < 0.3 * words


@lru_cache(maxsize=10_000)
def _heads(name: str) -> bool:
    return any(t in HEADER_NAMES or t.split("-")[-1] in HEADER_NAMES for t in name.lower().replace("_", "-").split())


def boilerplate(node: Node, inside_main: bool, inside_article: bool = False) -> bool:
    """Whether a node has a role that is never content.

    A form that holds an article, or most of the page's text, is the page; so is what a template names like a part of it. Inside
    an article a doubtful name goes only with what does not read like a part of the article; texts that repeat go by the votes anyway.
    """
    if node.hidden or node.tag in DROPPED_TAGS and node.tag != "form":
        return True
    if node.tag == "form" and not (node.holds or _most(node)):
        return True
    if node.tag == "header" or node.name and node.tag not in ("html", "body", "main", "article") and _heads(node.name):  # one inside the article holds its heading
        return not inside_main and not node.holds
    if not node.name or node.tag in ("html", "body", "main"):
        return False
    level = _named(node.name, node.tag == "article", inside_article)
    if not level or node.tag == "article":
        return bool(level)
    # what holds the page is not named after a part of it
    if node.holds or not inside_main and _holder(node.name) and _most(node):
        return False
    return not (inside_article and level != SURE and _part_of_article(node, level))


def texts(node: Node) -> Iterator[Node]:
    """All text nodes below, in page order."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag or x.parent is None:
            stack.extend(reversed(x.children))
        else:
            yield x


_P, _B = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


class Page:
    """A parsed page and, once it is measured, its elements numbered in page order and what votes need of their texts."""

    def __init__(self, html: str) -> None:
        self.root = parse(html)
        self.body = next((n for n in _walk(self.root) if n.tag == "body"), self.root)
        self.nodes: list[Node] = []
        self._lines: dict[str, int] | None = None

    def measured(self) -> Page:
        if not self.nodes:
            self._measure()
        return self

    def _measure(self) -> None:
        self._sums, self._powers, self._words, self._linked, self._links = [0], [1], [0], [0], [0]
        stack: list[tuple[Node, bool, bool]] = [(self.body, False, False)]
        while stack:
            node, leave, linked = stack.pop()
            if leave:
                a, b = node.at[0], len(self._sums) - 1
                node.at = (a, b)
                node.key = (self._sums[b] - self._sums[a] * self._powers[b - a]) % _P if b > a else 0
            elif not node.tag and node.parent is not None:
                if words := (entities.unescape(node.text) if "&" in node.text else node.text).split():
                    h = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                    self._sums.append((self._sums[-1] * _B + h) % _P)
                    self._powers.append(self._powers[-1] * _B % _P)
                    self._words.append(self._words[-1] + len(words))
                    self._linked.append(self._linked[-1] + len(words) * linked)
                    self._links.append(self._links[-1] + linked)
            elif node.tag not in SKIPPED:
                node.number, node.at = len(self.nodes), (len(self._sums) - 1, 0)
                # what is inside an element that its tag drops is of no use to know
                node.elements = [] if node.tag in DROPPED_TAGS and node.tag != "form" else [c for c in node.children if c.tag and c.tag not in FORMATTING and c.tag not in SKIPPED]
                self.nodes.append(node)
                stack.append((node, True, False))
                stack.extend((c, False, linked or node.tag == "a") for c in reversed(node.children))

    def words(self, node: Node) -> int:
        return self._words[node.at[1]] - self._words[node.at[0]]

    def linked(self, node: Node) -> int:
        """Words in links."""
        return self._linked[node.at[1]] - self._linked[node.at[0]]

    def links(self, node: Node) -> int:
        return self._links[node.at[1]] - self._links[node.at[0]]

    def lines(self) -> dict[str, int]:
        """The blocks of the page without a wrapper, and their lengths."""
        if self._lines is None:
            self._lines = {x: len(x) for x in read(self).split("\n") if x}
        return self._lines


def kind_of(node: Node) -> str:
    """Tag and class tokens; digits in them, as of ids, do not count."""
    return f"{node.tag}.{re.sub('[0-9]+', '#', node.name)}" if node.name else node.tag


def layout(page: Page) -> int:
    """Identifier of the set of a page's structural elements, as a signed long; what is inside articles does not count.

    A path is the hash of its parent's and its last step, so memory is one number an element, however deep.
    """
    found, stack = set(), [(page.body, 0)]
    while stack:
        node, path = stack.pop()
        for c in node.children:
            if not c.tag or c.tag in FORMATTING or c.tag in SKIPPED:
                continue
            own = xxhash.xxh64_intdigest(kind_of(c).encode("utf-8", "surrogatepass"), path)
            if c.name or c.tag in ("nav", "header", "footer", "article", "main", "aside", "section", "form"):
                found.add(own)
            if c.tag != "article" and c.tag in BLOCKS and (c.tag not in DROPPED_TAGS or c.tag == "form"):
                stack.append((c, own if c.name or c.tag not in ("div", "p") else path))
    return xxhash.xxh64_intdigest(np.array(sorted(found), np.uint64).tobytes()) - (1 << 63)


class Level:
    """Nodes side by side, and what is below them, to be scored against one node at once."""

    def __init__(self, nodes: list[Node]) -> None:
        self.size, self.nodes = len(nodes), nodes
        at: dict[object, list[int]] = {}
        for j, q in enumerate(nodes):
            for k in (q.tag, (q.tag, q.name), (q.tag, q.key)):
                at.setdefault(k, []).append(j)
        self.at = {k: np.array(v) for k, v in at.items()}
        self.parents = np.array([j for j, q in enumerate(nodes) if q.elements], np.int64)
        self._kept: dict[tuple[str, str], np.ndarray] = {}
        self._below: Level | None = None

    def scores(self, p: Node) -> np.ndarray:
        """``Match._score`` of a node with each; 0 for those of other tags."""
        w = self._kept.get((p.tag, p.name))
        if w is None:
            w = np.zeros(self.size, np.int64)
            if p.tag in self.at:
                w[self.at[p.tag]] = 1_000_000
            if (p.tag, p.name) in self.at:
                w[self.at[p.tag, p.name]] += 1
            if len(self._kept) < 64:
                self._kept[p.tag, p.name] = w
        same, deep = self.at.get((p.tag, p.key)), p.elements and len(self.parents) and p.tag in self.at
        if same is not None or deep:
            w = w.copy()
        if same is not None:
            w[same] += 2
        if deep:
            w[self.parents] += np.where(w[self.parents] > 0, self._totals(p.elements), 0)
        return w

    def _totals(self, elements: list[Node]) -> np.ndarray:
        """The last entries of the tables of ``elements`` with the children of each that has some."""
        if self._below is None:
            counts = np.array([len(self.nodes[j].elements) for j in self.parents])
            self._of, self._end = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
            self._first = self._end - counts
            self._below = Level([c for j in self.parents for c in self.nodes[j].elements])
        row = np.zeros(self._below.size, np.int64)
        for p in elements:
            if p.tag in self._below.at:
                left = np.empty_like(row)
                left[1:] = row[:-1]
                left[self._first] = 0
                row = np.maximum(row, left + self._below.scores(p))
                lift = self._of * (int(row.max()) + 1)  # running maxima begin anew at each parent
                row = np.maximum.accumulate(row + lift) - lift
        return row[self._end - 1]


def _next(row: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The next row of a table of two lists."""
    out = np.zeros_like(row)
    out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + scores))
    return out


class Match:
    """Simple tree matching of two pages' bodies, or of given nodes."""

    def __init__(self, a: Page, b: Page) -> None:
        self.a, self.b = a.measured(), b.measured()
        self._scores: dict[tuple[int, int], int] = {}
        self._levels: dict[int, Level] = {}

    def pairs(self, p: Node | None = None, q: Node | None = None) -> list[tuple[Node, Node]]:
        """The matched pairs; none for roots of different tags."""
        p, q = p or self.a.body, q or self.b.body
        if p.tag != q.tag:
            return []
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 4 * (len(self.a.nodes) + len(self.b.nodes)) + 1000))  # frames of Python only
        try:
            self._score(p, q)
        finally:
            sys.setrecursionlimit(limit)
        out, stack = [], [(p, q)]
        while stack:
            p, q = stack.pop()
            out.append((p, q))
            if p.elements and q.elements:
                stack.extend(reversed([(p.elements[i], q.elements[j]) for i, j in self._chosen(p.elements, q.elements)]))
        return out

    def _score(self, p: Node, q: Node) -> int:
        """Pairs matched below two nodes of one tag, itself included, in millions; names and texts that agree are the rest."""
        one = 1_000_000 + (p.name == q.name) + 2 * (p.key == q.key)
        if not p.elements or not q.elements:
            return one
        known = self._scores.get((p.number, q.number))
        if known is None:
            known = one + self._total(p.elements, q.elements)
            self._scores[p.number, q.number] = known
        return known

    def _total(self, x: list[Node], y: list[Node]) -> int:
        """The last entry of their table."""
        if len(x) * len(y) <= CELLS:
            return self._table(x, y)[-1][-1]
        level, row = self._level(y), np.zeros(len(y) + 1, np.int64)
        for p in x:
            row = _next(row, level.scores(p))
        return int(row[-1])

    def _level(self, y: list[Node]) -> Level:
        """``y``: the elements of a node, which lives as long as the page."""
        if id(y) not in self._levels:
            self._levels[id(y)] = Level(y)
        return self._levels[id(y)]

    def _table(self, x: list[Node], y: list[Node]) -> list[list[int]]:
        table = [[0] * (len(y) + 1)]
        for p in x:
            above, row, left = table[-1], [0], 0
            tag, name, key, elements = p.tag, p.name, p.key, p.elements
            for j, q in enumerate(y):
                best = above[j + 1] if above[j + 1] > left else left
                if tag == q.tag:
                    # as _score has it for leaves
                    one = self._score(p, q) if elements and q.elements else 1_000_000 + (name == q.name) + 2 * (key == q.key)
                    if (one := one + above[j]) > best:
                        best = one
                row.append(left := best)
            table.append(row)
        return table

    def _chosen(self, x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if len(x) * len(y) > CELLS:
            self._traced(x, self._level(y), 0, len(x), np.zeros(len(y) + 1, np.int64), len(y), out)
            return out[::-1]
        table, i, j = self._table(x, y), len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def _traced(self, x: list[Node], level: Level, lo: int, hi: int, row: np.ndarray, j: int, out: list[tuple[int, int]]) -> int:
        """Go back from column ``j`` of row ``hi`` to row ``lo``, which is ``row``, and give the column there; pairs go to ``out``, last first."""
        if hi - lo == 1:
            new = _next(row, level.scores(x[lo])[:j])
            while j and new[j] != row[j]:
                j -= 1
                if new[j + 1] != new[j]:
                    out.append((lo, j))
                    break
            return j
        n = min(PARTS, hi - lo)
        cuts, rows = [lo + (hi - lo) * k // n for k in range(n + 1)], [row]
        for a, b in zip(cuts, cuts[1:-1]):
            for p in x[a:b]:
                row = _next(row, level.scores(p)[:j])
            rows.append(row)
        for a, b in reversed(list(zip(cuts, cuts[1:]))):
            row = rows.pop()
            if j:
                j = self._traced(x, level, a, b, row[: j + 1], j, out)
        return j


@dataclass
class Reference:
    """A page that others are aligned with; ``template`` and ``menus`` are numbers of nodes."""

    page: Page
    template: frozenset[int] = frozenset()
    menus: frozenset[int] = frozenset()

    def tells(self) -> bool:
        """Whether some template node or menu is not one that its role drops anyway."""
        if self._tells is None:
            self._tells = any(not _dropped(self.page.nodes[k]) for k in self.template | self.menus)
        return self._tells

    _tells: bool | None = None


@lru_cache(maxsize=512)
def reference(html: str, template: tuple[int, ...] = (), menus: tuple[int, ...] = ()) -> Reference:
    return Reference(Page(html).measured(), frozenset(template), frozenset(menus))


def votes(page: Page, ref: Reference) -> dict[int, tuple[int, int, int, int, int]] | None:
    """Of each node of the reference that the page is aligned with: 1, whether texts agree, words, words in links, links. None for a copy."""
    own, theirs = page.lines(), ref.page.lines()
    shared = sum(n for x, n in own.items() if x in theirs)
    if 2 * shared > min(sum(own.values()), sum(theirs.values())):
        return None
    out = {}
    for p, q in Match(page, ref.page).pairs():
        if p.tag not in ("body", "") and (n := page.words(p)):
            out[q.number] = (1, int(p.key == q.key), n, page.linked(p), page.links(p))
    return out


def _dropped(node: Node) -> bool:
    """Whether a node or what holds it has a role that is never content."""
    inside = inside_article(node)
    while node is not None:
        if node.tag and boilerplate(node, inside, inside):
            return True
        node = node.parent
    return False


def inside_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def judged(ref: Reference, counts: dict[int, tuple[int, int, int, int, int]], voters: int) -> tuple[list[int], list[int]]:
    """(template nodes, menus) of a reference from the summed votes of all pages."""
    template, menus = [], []
    for number, (aligned, same, words, linked, links) in sorted(counts.items()):
        node = ref.page.nodes[number]
        inside = inside_article(node)
        if node.tag == "main" or aligned < MIN_VOTES:
            continue
        if same >= MIN_VOTES and (same >= CONSTANT * aligned or ref.page.words(node) >= PHRASE and same >= REPEATED * voters):
            if not (inside and re.fullmatch("h[1-6]", node.tag)):
                template.append(number)
        elif not inside and node.tag in BLOCKS and linked >= LINKED * words and links >= 2 * aligned:
            menus.append(number)
    return template, menus


def induce(pages: list[str]) -> list[Reference]:
    """References and their wrappers from the pages of one layout; the twin of :func:`wrappers` for one list."""
    parsed = [Page(p) for p in pages]
    out = []
    for html in sorted(set(pages), key=lambda p: xxhash.xxh64_intdigest(p))[:REFERENCES]:
        ref, total, voters = reference(html), {}, 0
        for p in parsed:
            if (own := votes(p, ref)) is not None:
                voters += 1
                for k, v in own.items():
                    total[k] = tuple(map(sum, zip(total.get(k, (0,) * 5), v)))
        out.append(reference(html, *map(tuple, judged(ref, total, voters))))
    return out


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def regions(root: Node) -> list[Node]:
    """The outermost article and main elements that are content, in page order; where there are none, the page."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag and boilerplate(node, False):
            continue
        if node.tag in ("article", "main"):
            out.append(node)
        else:
            stack.extend(reversed(node.children))
    # a main element holds what is beside its articles, and articles beside it count as well
    return out or [root]


def read(page: Page, wrapper: tuple[Reference, ...] | list[Reference] = ()) -> str:
    """Main text of one page under its layout's wrapper."""
    gone: set[int] = set()
    for ref in wrapper:
        if ref.tells():
            for p, q in Match(page, ref.page).pairs():
                if q.number in ref.template and p.key == q.key and p.key:
                    gone.add(p.number)
                elif q.number in ref.menus and page.linked(p) >= LINKED * page.words(p):
                    gone.add(p.number)
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if s := " ".join(entities.unescape("".join(line)).split()):
            out.append(s)
        line.clear()

    for region in regions(page.root):
        inside = region.tag in ("article", "main")
        stack: list[tuple[Node, bool, bool]] = [(region, False, inside and not (region.tag == "main" and region.holds))]
        while stack:
            node, leave, article = stack.pop()
            if leave:
                end()
            elif not node.tag and node.parent is not None:
                line.append(node.text)
            elif node is not region and boilerplate(node, inside, article) or node.number in gone:
                end() if node.tag in BLOCKS else None
            else:
                if node.tag in BLOCKS:
                    end()
                    stack.append((node, True, article))
                article = article or node.tag == "article"
                stack.extend((c, False, article) for c in reversed(node.children))
        end()
    return "\n".join(out)


def extract(html: str | None, wrapper: tuple[Reference, ...] | list[Reference] = ()) -> str:
    """Main text of the html of one page."""
    return read(Page(html or ""), wrapper)


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


REFS = "array<struct<h:long,html:string,template:array<int>,menus:array<int>>>"


def _held(refs: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """References computed once: rows of the driver where all are small (and the same as a table), else a table in the shared folder."""
    refs = refs.persist()
    size = refs.agg(F.coalesce(F.sum(F.octet_length("html") + 200), F.lit(0))).collect()[0][0]
    rows = sorted(refs.collect(), key=lambda r: r["h"]) if size <= BROADCAST_BYTES else None  # as large as was just measured
    out = refs.sparkSession.createDataFrame(rows, refs.schema) if rows is not None else cut(refs)
    refs.unpersist()
    return out, rows


def _known(a: DataFrame, refs: DataFrame, rows: list[Row] | None) -> tuple[DataFrame, object]:
    """``a`` (with host and html) and how a row finds its references: a broadcast by (host, layout), or None where ``a`` got a column ``refs``.

    ``refs`` (and ``rows``, as :func:`_held` has them): host, layout, h, html, template and menus.
    """
    if rows is not None:
        known: dict[tuple[str, int], list[tuple]] = {}
        for r in rows:
            known.setdefault((r["host"], r["layout"]), []).append((r["h"], r["html"], tuple(r["template"]), tuple(r["menus"])))
        return a, a.sparkSession.sparkContext.broadcast(known)
    of = refs.groupBy(F.col("host").alias("__host"), F.col("layout").alias("__layout")).agg(F.sort_array(F.collect_list(F.struct("h", "html", "template", "menus"))).alias("refs"))
    laid = a.mapInArrow(_laid, a.withColumn("layout", F.lit(0).cast("long")).schema)
    return laid.join(of, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout")), "left").drop("__host", "__layout"), None


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.names.index("html")
        own = [layout(Page(h.as_py() or "")) for h in b.column(at)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "layout"])


def _pages(b: pa.RecordBatch, shared) -> Iterator[tuple[Page, str, list[tuple]]]:
    """(page, host, references) of every row of a batch of :func:`_known`."""
    get = b.column
    for i, (host, html) in enumerate(zip(get(b.schema.names.index("host")).to_pylist(), get(b.schema.names.index("html")))):
        page = Page(html.as_py() or "")
        if shared is not None:
            yield page, host, shared.value.get((host, layout(page)), []) if host else []
        else:
            yield page, host, [(r["h"], r["html"], tuple(r["template"]), tuple(r["menus"])) for r in get(b.schema.names.index("refs"))[i].as_py() or ()]


#: Sums of votes that a task holds before it gives them away.
HELD = 100_000


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, h, html, template and menus of the references of every layout of every host. ``pages``: host and html."""
    some = pages.filter("host <> '' and html is not null")
    laid = some.mapInArrow(_laid, some.withColumn("layout", F.lit(0).cast("long")).schema).select("host", "layout", F.xxhash64("html").alias("h"))
    by_hash = Window.partitionBy("host", "layout").orderBy("h")  # limited in each task before rows move
    keys = laid.distinct().withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= REFERENCES).select(F.col("host").alias("__host"), "layout", F.col("h").alias("__h")).persist()
    small = F.broadcast(keys) if keys.count() <= KEY_ROWS else keys
    found = some.join(small, (F.col("host") == F.col("__host")) & (F.xxhash64("html") == F.col("__h")))
    none = F.array().cast("array<int>")
    refs, rows = _held(found.groupBy("host", "layout", F.col("__h").alias("h")).agg(F.min("html").alias("html")).withColumns({"template": none, "menus": none}))
    keys.unpersist()
    a, shared = _known(some.select("host", "html"), refs, rows)
    names = ["host", "layout", "h", "node", "aligned", "same", "words", "linked", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list[int]] = {}

        def given() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in total.items()]
            total.clear()
            kinds = [pa.string(), *[pa.int64()] * 8]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

        for b in batches:
            for page, host, refs in _pages(b, shared):
                own = layout(page)
                for h, html, *_ in refs:
                    if (v := votes(page, reference(html))) is not None:
                        for node, new in ((-1, (1, 0, 0, 0, 0)), *v.items()):
                            have = total.setdefault((host, own, h, node), [0] * 5)
                            for i, x in enumerate(new):
                                have[i] += x
            if len(total) > HELD:
                yield given()
        yield given()

    counted = a.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'host' else 'long'}" for c in names))
    summed = counted.groupBy("host", "layout", "h", "node").agg(*[F.sum(c).alias(c) for c in names[4:]]).filter("node = -1 or aligned >= 2")
    # at most as many as the reference has nodes
    of = summed.groupBy(F.col("host").alias("__host"), F.col("layout").alias("__layout"), F.col("h").alias("__h")).agg(F.collect_list(F.struct(*names[3:])).alias("counts"))
    joined = refs.join(of, (F.col("host") == F.col("__host")) & (F.col("layout") == F.col("__layout")) & (F.col("h") == F.col("__h")), "left").select("host", "layout", "h", "html", "counts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for html, counts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                by = {c["node"]: tuple(c[x] for x in names[4:]) for c in counts or ()}
                voters = by.pop(-1, (0,))[0]
                found.append(judged(reference(html), by, voters))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], kind)], names=[*b.schema.names[:4], "template", "menus"])

    return joined.mapInArrow(judge, refs.schema)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` of every row."""
    a = pages.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("__keep"), _host("url").alias("host"), "html")
    a, shared = _known(a, *_held(wrappers(a.select("host", "html")).filter("size(template) + size(menus) > 0")))
    schema = a.select("__keep").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [read(page, [reference(html, t, m) for _, html, t, m in refs]) for page, _, refs in _pages(b, shared)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=schema.names)

    return a.mapInArrow(run, schema).select("__keep.*", "text")


def query(pages: DataFrame) -> DataFrame:
    """op3: main text of every page and its code points."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
