"""Main text of web pages by composite text density.

A page becomes a tree of elements.  For every element: characters, characters inside links, tags and
link tags of its subtree; its density is characters per tag, adjusted by how its text divides between
links and plain text.  An element's density sum is the sum over its children.  The element with the
largest sum is the core; the smallest density on its path to the root is the threshold; from the root
down, each element over the threshold contributes its subtree's element with the largest sum.

What an element is called never decides alone.  Elements that HTML itself sets apart from an article
(scripts, forms, navigation, footers, page headers, hidden ones, ...) are cut before.  A block whose whole
class or id names it an advert, notice, menu and the like counts with a fraction of its density, and
inside the core it goes if it is also short beside the core or mostly links.  Headings have no names, and a
block whose id repeats words of its own heading goes only if it is mostly links.  Reader comments, which
are as dense as articles, go where a text is left without them.

Headings go with what they head: those inside the smallest element that holds all that was taken stay,
and so do those before it with nothing but headings between.
`<article>` and `<main>` decide between elements of equal sums, then the one with more text, then the first.

Decoded text: white space inside a block becomes one space, blocks are joined by newlines.  Null or
empty html, and pages without text: the empty string.  Unclosed, stray and truncated tags are allowed;
the time of a page is linear in its length, so a very long one only takes longer.  Rows are
independent; repeated rows and null ids keep their places.  Empty table: no rows.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CUT = frozenset("script style noscript template svg math iframe object embed canvas audio video head title nav footer aside form button select textarea dialog menu map noembed noframes xmp datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th"), "p": ("p",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table article section div main aside body html td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification newsletter"
    " subscribe subscription signup login share sharing social sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead header toolbar"
    " related recommended recommendations popup modal overlay widget widgets pagination pager skip sitemap".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
NEVER_NAMED = frozenset("html body article main h1".split())
#: Words that may stand beside those in a name without changing what it names; the second kind beside comments only.
BESIDE = frozenset("main site page top bottom left right box wrap wrapper container list bar block area slot unit link links item items inner outer primary secondary global side column col holder panel group row zone button buttons".split())
BESIDE_COMMENTS = BESIDE | frozenset("post entry article user reader section thread form".split())

#: How a name weighs: the factor of the density of what is named; shares of characters that make a block short or linked; characters that make a text.
NAMED_WEIGHT, SHORT_SHARE, LINKED_SHARE, LEAST_TEXT = 0.1, 0.15, 0.25, 140

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]{2,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "attributes", "named", "titled", "chars", "link_chars", "tags", "link_tags", "density", "total", "best", "main")

    def __init__(self, name: str, parent: Node | None, attributes: str = ""):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Node | str] = []
        self.named = self.titled = self.main = False

    @property
    def below(self) -> list[Node]:
        return [x for x in self.children if not isinstance(x, str)]


class _Source:
    """A page's tags, front to back; no part of the page is searched twice for the same thing."""

    def __init__(self, text: str):
        self.text, self.none_from = text, {}

    def find(self, what: str, at: int) -> int:
        """Where `what` next is, or -1; once it isn't found, it isn't sought again."""
        if at >= self.none_from.get(what, len(self.text) + 1):
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none_from[what] = at
        return found

    def after(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return len(self.text) if found < 0 else found + len(what)

    def tag_end(self, at: int) -> tuple[int, int]:
        """End of a tag's attributes and where the text goes on; quoted values may hold >."""
        begin = at
        while m := _IN_TAG.search(self.text, at):
            if m[1] is None:
                return m.start(), m.end()
            close = self.find(m[1], m.end())
            if close < 0:  # a quote that nothing closes is no quote
                stop = self.find(">", m.end())
                return (len(self.text),) * 2 if stop < 0 else (stop, stop + 1)
            at = close + 1
        return len(self.text), max(begin, len(self.text))


def parse(source: str) -> Node:
    root = here = Node("html", None)
    tags, at, end = _Source(source), 0, len(source)
    open_: dict[str, int] = {}

    def close(upto: Node) -> Node:
        """Closes elements up to and with this one."""
        node = here
        while True:
            open_[node.name] -= 1
            if node is upto:
                return node.parent
            node = node.parent

    while at < end:
        begin = tags.find("<", at)
        if begin < 0:
            here.children.append(source[at:])
            break
        if begin > at:
            here.children.append(source[at:begin])
        at = begin + 1
        if source.startswith("!--", at):
            at = tags.after("-->", at + 3)
            continue
        if source.startswith("![CDATA[", at):
            stop = tags.find("]]>", at + 8)
            here.children.append(html.escape(source[at + 8 : stop if stop >= 0 else end], quote=False))
            at = stop + 3 if stop >= 0 else end
            continue
        if at < end and source[at] in "!?":
            at = tags.after(">", at)
            continue
        ends = source.startswith("/", at)
        m = _NAME.match(source, at + ends)
        if m is None:
            if ends:
                at = tags.after(">", at)
            else:
                here.children.append("<")
            continue
        name = m[0].lower()
        stop, at = tags.tag_end(m.end())
        attributes = source[m.end() : stop]
        if ends:  # closes up to its start tag, if that is open
            if open_.get(name):
                node = here
                while node.name != name:
                    node = node.parent
                here = close(node)
            continue
        if name in ("html", "body") and here is root:
            continue
        for other in (("p",) if name in CLOSES_P else ()) + SAME_CLOSES.get(name, ()):
            if open_.get(other):
                node = here
                while node is not root and node.name != other and (node.name not in SCOPE or (other in ("tr", "td", "th") and node.name in ("td", "th"))):
                    node = node.parent
                if node is not root and node.name == other:
                    here = close(node)
        node = Node(name, here, attributes)
        here.children.append(node)
        if name in RAW:
            ending = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            node.children.append(source[at : ending.start() if ending else end])
            at = tags.after(">", ending.end()) if ending else end
        elif name not in VOID and not attributes.rstrip().endswith("/") or name in ("p", "div", "span", "a"):
            here = node
            open_[name] = open_.get(name, 0) + 1
    return root


def _said(node: Node) -> str:
    """What an element's attributes say of it: "out" if it is hidden or has the role of something else, "comments", "named", "titled" or nothing.

    Headings have no name: their ids are made from their texts.  A block whose id repeats words of its own heading is titled by it.
    """
    found = ""
    for m in _ATTRIBUTE.finditer(node.attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "out"
        if key in ("class", "id") and node.name not in HEADINGS:
            for word in value.split():
                parts = set(_LETTERS.findall(_HUMP.sub("-", word).lower()))
                if parts & COMMENTS and parts <= COMMENTS | BESIDE_COMMENTS:
                    found = "comments"
                elif parts & NAMES and parts <= NAMES | BESIDE:
                    titled = key == "id" and parts <= _heading_words(node)
                    found = found if found in ("comments", "named") else "titled" if titled else "named"
    return found


def _heading_words(node: Node) -> set[str]:
    """Words of the headings directly in a block."""
    own = [x for x in node.children if not isinstance(x, str) and x.name in HEADINGS]
    return {w for x in own for y in x.children if isinstance(y, str) for w in _LETTERS.findall(y.lower())}


def _plain(root: Node) -> int:
    """Characters outside links."""
    total, pending = 0, [root]
    while pending:
        node = pending.pop()
        for x in node.children:
            if isinstance(x, str):
                total += len("".join(x.split()))
            elif x.name != "a":
                pending.append(x)
    return total


def prune(root: Node) -> None:
    """Cuts what HTML sets apart, and reader comments where a text is left; marks what is named. A page's header goes, an article's own stays."""
    pending: list[tuple[Node, bool]] = [(root, False)]
    comments: list[Node] = []
    while pending:
        node, inside = pending.pop()
        kept: list[Node | str] = []
        for x in node.children:
            if not isinstance(x, str):
                said = _said(x) if x.attributes and x.name not in NEVER_NAMED else ""
                if x.name in CUT or said == "out" or (x.name == "header" and not inside):
                    continue
                x.named, x.titled = said in ("named", "comments"), said == "titled"
                if said == "comments":
                    comments.append(x)
                pending.append((x, inside or x.name in ("article", "main")))
            kept.append(x)
        node.children = kept
    if comments:
        every, within = _plain(root), {id(x) for x in comments}
        outermost = [x for x in comments if not _inside(x, within)]
        inner = sum(map(_plain, outermost))
        if every - inner >= min(LEAST_TEXT, 0.1 * inner):
            for x in outermost:
                x.parent.children = [y for y in x.parent.children if y is not x]


def _inside(node: Node, some: set[int]) -> bool:
    while (node := node.parent) is not None:
        if id(node) in some:
            return True
    return False


def _ordered(root: Node) -> list[Node]:
    """Elements, parents before children."""
    out, pending = [], [root]
    while pending:
        node = pending.pop()
        out.append(node)
        pending.extend(x for x in reversed(node.children) if not isinstance(x, str))
    return out


def measure(root: Node) -> list[Node]:
    nodes = _ordered(root)
    for node in reversed(nodes):
        below = node.below
        node.chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) + sum(x.chars for x in below)
        node.tags = len(below) + sum(x.tags for x in below)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(x.link_chars for x in below), sum(x.link_tags for x in below)
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = c / max(1, lc) * (t / lt)
        node.density = c / t * max(0.0, math.log(max(ratio, 1.0)) / base) * (NAMED_WEIGHT if node.named else 1.0) if c else 0.0
        # inline elements are part of their block's text, not parts of the page
        node.total = sum(x.total if x.name in INLINE else x.density for x in node.below)
        node.best = max([node, *(x.best for x in node.below)], key=_rank)
    return nodes


def _rank(node: Node) -> tuple:
    return node.total * (NAMED_WEIGHT if node.named else 1.0), node.name in ("article", "main"), node.chars


def _holder(some: list[Node]) -> Node:
    """The smallest element that holds them all."""
    path = []
    for k, node in enumerate(some):
        own = []
        while node is not None:
            own.append(node)
            node = node.parent
        own.reverse()
        path = own if not k else [x for x, y in zip(path, own, strict=False) if x is y]
    return path[-1]


def select(root: Node) -> None:
    """Marks what is taken: `main` of an element takes its subtree, but for named blocks that are short or linked."""
    nodes = measure(root)
    core = root.best
    if core.total <= 0:
        root.main = True
        return
    core.main = True
    threshold, node = core.density, core
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    pending, taken = [root], [core]
    while pending:
        node = pending.pop()
        if node.main or node.density < threshold or not node.chars:
            continue
        best = node.best if node.best.total > 0 else node
        if not best.main and best.density >= threshold:
            best.main = True
            taken.append(best)
        pending.extend(node.below)
    within = {id(x) for x in taken}
    chars = sum(x.chars for x in taken if not _inside(x, within))
    for node in nodes:
        if node.named and node.chars < SHORT_SHARE * chars or (node.named or node.titled) and node.link_chars > LINKED_SHARE * node.chars:
            node.children = []
    holder = _holder(taken)
    pending = [holder]
    while pending:
        node = pending.pop()
        if node.name in HEADINGS:
            node.main = True
        elif not node.main:
            pending.extend(node.below)
    node = holder
    while node.parent is not None:  # and upwards, as long as there is nothing but headings beside it
        beside = [x for x in node.parent.below if x is not node and x.chars]
        at = node.parent.below.index(node)
        for x in node.parent.below[:at]:
            x.main = x.main or x.name in HEADINGS
        if any(x.name not in HEADINGS for x in beside):
            break
        node = node.parent


def blocks(root: Node) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    pending: list[tuple[Node | str | None, bool]] = [(root, False)]
    while pending:
        x, inside = pending.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                held.append(x)
        elif x.name == "br":
            held.append(" ")
        else:
            inside = inside or x.main
            block = x.name not in INLINE
            if block:
                end()
                pending.append((None, False))
            pending.extend((y, inside) for y in reversed(x.children))
    end()
    return out


def extract(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    prune(root)
    select(root)
    return "\n".join(blocks(root))


def _extract_all(pages: pd.Series) -> pd.Series:
    return pages.map(extract, na_action=None)


def html_main_text(df: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row."""
    out = df.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.pandas_udf(_extract_all, "string")(F.coalesce(F.col(html_column).cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
