"""Main text of web pages by composite text density (Sun, Song & Liao 2011).

Every DOM node gets its link-adjusted characters per tag. A block's density sum
adds up the densities of the blocks in it, and of the text that it holds itself,
which counts as one more block. The block with the largest sum is the main text,
and the smallest density on its path up to the body is the threshold for all else:
going up that path, an ancestor takes its place if most of what else it holds
reaches the threshold, so that a title or a second section isn't lost; of the body
only the children that reach it are added. Which tags or classes a page uses for
its article plays no part in that.

Scripts, styles, forms and hidden elements are no text. Elements that say by tag,
role, class or id that they are headers, footers, sidebars, notices, adverts or
comments hold sentences as an article does, which no density tells apart: they
can't be chosen and add nothing to a sum. Menus and other lists of links are left
to the densities, which rate links low. A page whose largest sum is a menu's has
no article. What is named as any of these is left out of what is chosen.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import small_batches, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: One attribute after another, each with its value; a quoted value without a name has an empty one.
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that end an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Elements of which one of the same kind ends the last.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table select".split())
#: Elements without text of the page, and elements that are no part of an article.
UNSEEN = frozenset("head form button select input label fieldset".split())
DROPPED = UNSEEN | frozenset("nav footer aside menu dialog".split())
TITLES = frozenset("h1 h2 h3".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Parts of class names and ids that say an element is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar sidebars aside widget widgets related recommended share sharing social "
    "comment comments disqus reply replies discussion respond newsletter subscribe subscription signup login form search pagination pager toolbar skip copyright".split()
)
_WHOLE = frozenset("html body article main".split())
#: Of these, the names of lists of links.
_MENU_TAGS, _MENU_ROLES = frozenset(["nav", "menu"]), frozenset("navigation menu menubar toolbar".split())
_MENU_MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs related recommended share sharing social pagination pager toolbar skip".split())


class _Tree:
    """Nodes in document order: parent, tag, marks; texts as (node, text, block number)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.out, self.unseen, self.menu = [-1], ["#root"], [False], [False], [False]
        self.texts: list[tuple[int, str, int]] = []
        self._block, self._stack, self._lead = 0, [0], set()
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                self._close(tag)
            else:
                self._open(tag, m[4])
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], text, self._block))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close("p", within=_SCOPES | {"td", "th", "div", "article", "section", "main", "body", "li", "button"})
        for other in _SIBLINGS.get(tag, ()):
            self._close(other, within=_SCOPES)
        if tag in BLOCK:
            self._block += 1
        if tag in ("br", "td", "th"):
            self._text(" ")
        if tag in ("html", "body", "head") and tag in self.tag:
            return
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.out.append(self._boilerplate(tag, attributes))
        self.menu.append(self._menu)
        self.unseen.append(self.unseen[self._stack[-1]] or tag in UNSEEN or self._hidden)
        if tag in ("h1", "main"):
            self._lead.update(self._stack)
        if tag not in VOID and not attributes.endswith("/"):
            self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str, within: frozenset | set = frozenset()) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            open_tag = self.tag[self._stack[depth]]
            if open_tag == tag:
                del self._stack[depth:]
                if tag in BLOCK:
                    self._block += 1
                return
            if open_tag in within:
                return

    def _boilerplate(self, tag: str, attributes: str) -> bool | None:
        """True: no part of an article. None: so by its class or as an article's header, unless it holds the title."""
        found: bool | None = False
        self._hidden, self._menu = False, tag in _MENU_TAGS
        if tag in DROPPED:
            return True
        if tag == "header":
            if not any(self.tag[i] in ("article", "main") for i in self._stack):
                return True
            found = None
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                self._hidden, self._menu = True, False
                return True
            if name == "role" and value.lower() in ROLES:
                self._menu = value.lower() in _MENU_ROLES
                return True
            if name in ("class", "id") and tag not in _WHOLE:
                marks = {p.lower() for p in _PART.findall(value)} & MARKS
                if marks:
                    self._menu = marks <= _MENU_MARKS and (self._menu or found is False)
                    found = None
        return found

    def pruned(self, kept: list[bool] | None = None) -> list[bool]:
        """Per node, whether it or one above it is no part of an article; those of kept don't count."""
        gone = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            own = self.out[i] is True or (self.out[i] is None and i not in self._lead)
            gone[i] = gone[self.parent[i]] or (own and not (kept and kept[i]))
        return gone


def _density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite density of c characters and t tags, of which lc and lt in links; share: the page's characters in links."""
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    links = max(0.0, math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9))
    return c / t * links / math.log(base) if base > 1.0001 else c / t


def _densities(tree: _Tree, chars: list[int]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Per node: composite density, that of the text it holds itself if it is a block, characters, and those in links."""
    n = len(tree.tag)
    c, t, lc, lt = chars[:], [1] * n, [0] * n, [0] * n
    link, up = [False] * n, _blocks(tree)
    own = [[0, 0, 0, 0] for _ in range(n)]
    for i in range(n):
        link[i] = i > 0 and (link[tree.parent[i]] or tree.tag[i] == "a")
        if link[i]:
            lc[i], lt[i] = c[i], 1
        for k, x in enumerate((c[i], i != up[i], lc[i], lt[i] if i != up[i] else 0)):
            own[up[i]][k] += x
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        lt[p] += lt[i]
        t[p] += t[i]
    share = lc[0] / max(c[0], 1)
    # Tags below a node; one at least.
    density = [_density(c[i], max(1, t[i] - 1), lc[i], lt[i], share) if c[i] else 0.0 for i in range(n)]
    return density, [_density(x, max(1, k), lx, lk, share) if x else 0.0 for x, k, lx, lk in own], c, lc


def _blocks(tree: _Tree) -> list[int]:
    """Per node, the block that it is or stands in."""
    up = [0] * len(tree.tag)
    for i, tag in enumerate(tree.tag):
        up[i] = i if i == 0 or tag in BLOCK else up[tree.parent[i]]
    return up


def _chosen(tree: _Tree, gone: list[bool], density: list[float], own: list[float], chars: list[int], c: list[int], lc: list[int]) -> set[int]:
    """The nodes whose subtrees are the main text; none if it is a menu."""
    n = len(tree.tag)
    # Half in links at least, or densities can't tell a menu from text.
    away = tree.pruned([m and 2 * lc[i] >= c[i] for i, m in enumerate(tree.menu)])
    up, total, inner = _blocks(tree), own[:], [0] * n
    for i in range(1, n):
        if up[i] == i and c[i] and not away[i]:
            above = up[tree.parent[i]]
            total[above] += density[i]
            inner[above] += 1
    choice = [i for i in range(n) if inner[i] and not away[i]]
    # Without a block that holds others, the one with the densest text of its own.
    best = max(choice or (i for i in range(n) if not away[i]), key=lambda i: (total[i], -i))
    if gone[best]:
        return set()
    threshold, i = density[best], best
    while i > 0:
        threshold = min(threshold, density[i])
        i = tree.parent[i]

    below: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if c[i] and not gone[i]:
            below[tree.parent[i]].append(i)

    found, last = {best}, best
    while last > 0:
        at = tree.parent[last]
        beside = [i for i in below[at] if i != last]
        dense = [i for i in beside if (tree.tag[i] in TITLES or density[i] >= threshold) and lc[i] * 2 <= c[i]]
        of_page = at == 0 or tree.tag[at] in ("html", "body")
        if not of_page and 2 * (sum(c[i] for i in dense) + chars[at]) >= sum(c[i] for i in beside) + chars[at]:
            found = {at}
        else:  # a lone block beside the article has to weigh something to be a part of it
            found.update(i for i in dense if tree.tag[i] in TITLES or inner[i] > 1 or 2 * c[i] >= c[best])
        last = at
    return found


def main_text(source: str) -> str:
    """The article's blocks, joined by blank lines; empty if there is none."""
    tree = _Tree(source)
    gone = tree.pruned()
    pieces = [(i, html.unescape(x), b) for i, x, b in tree.texts if not tree.unseen[i]]
    chars = [0] * len(tree.tag)
    for i, x, _ in pieces:
        chars[i] += len(" ".join(x.split()))
    if not any(n and not g for n, g in zip(chars, gone, strict=True)):
        return ""
    density, own, c, lc = _densities(tree, chars)
    roots = _chosen(tree, gone, density, own, chars, c, lc)
    # Where the page itself is the main text, links ahead of all else are a menu.
    page = next((i for i in sorted(roots) if i == 0 or tree.tag[i] in ("html", "body")), None)
    first = next((i for i in range(len(tree.tag)) if chars[i] and not gone[i] and lc[i] * 2 <= c[i] and i != page), 0) if page is not None else 0
    kept = [False] * len(tree.tag)
    for i in range(len(tree.tag)):
        links = i < first and tree.tag[i] in ("ul", "ol", "div", "section", "table") and c[i] and lc[i] * 10 >= c[i] * 9 and i not in roots
        kept[i] = (i in roots or (i > 0 and kept[tree.parent[i]])) and not gone[i] and not links
    blocks: dict[int, list[str]] = {}
    for i, x, b in pieces:
        if kept[i]:
            blocks.setdefault(b, []).append(x)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Columns of pages but html, and text: the main text of each row's html.

    Null or empty html, and pages without an article, give an empty text; equal
    rows give equal texts; an empty table gives no rows; columns named text are
    replaced.
    """
    others = [c for c in pages.columns if c not in ("html", "text")]
    schema = pages.select(*others).schema.add("text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = pa.array([main_text(x or "") for x in b.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], texts], [*others, "text"])

    return small_batches(pages).select(*others, F.col("html").cast("string")).mapInArrow(work, schema)


def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
