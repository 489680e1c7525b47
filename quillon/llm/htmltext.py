"""Main text of web pages by tree scoring.

A page becomes a tree of elements, lenient about tags that are left open. Paragraph-like blocks earn points for length
and commas, discounted by link density, and pass them to their ancestors, half as much with each level, in one pass from
the leaves up. The container with the best score, discounted by link density and by what its names say, is kept with
those of its siblings that score well or read as prose.

Inside, what is no part of an article by its element or role goes: menus, headers, footers, sidebars, forms, scripts and
styles. Class words only weigh: a block named as an advert, a notice, a sidebar or the like goes if it is a minor part of
the page's text, so a wrapper with such a name that holds the article stays, and paragraphs, tables and quotations stay
whatever a mild name says. Blocks named as reader comments go unless they hold an article. Lists of short links go
where the page names no article, and stay within one.

Null and blank pages give the empty text. Of equal best scores the first container of the page is taken. Pages with a
null page_id or url, and repeated rows, give a row each; extra columns of any name are ignored; an empty table gives no
rows. Time grows with the length of a page, however deep it is nested.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import ship, table

#: Comments, character data, declarations and tags; a quote opens a value only after an equals sign and, if it is never
#: closed, is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"}
_DROP = {"nav", "footer", "aside", "form", "script", "style", "template", "head", "svg", "canvas", "button", "select", "option", "dialog", "menu", "audio", "video", "map", "input", "label", "fieldset", "datalist"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "status", "advertisement"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
_STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promoted", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "outbrain", "taboola", "pagination", "pager",
}
_MILD = {"banner", "promotion", "discussion", "reply", "notice", "notices", "alert", "related", "recommended", "recommendations", "widget", "skip", "copyright", "legal", "disclaimer", "form", "search", "tags", "byline", "tooltip"}
_GOOD_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text", "page", "blog", "hentry"}
_PROSE = {"p", "pre", "blockquote", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "caption", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar",
    "aside", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "discussion", "replies", "reply", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "skip", "copyright", "legal", "disclaimer", "form", "search", "tags", "byline", "outbrain", "taboola", "hidden", "tooltip",
}
_GOOD_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text", "page", "blog", "hentry"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LEAVES = {"p", "pre", "td", "blockquote", "dd", "li", "h1", "h2", "h3", "h4"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "score", "bad", "chars", "linked", "links", "commas", "holds", "words")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.score, self.chars, self.linked, self.links, self.commas = 0.0, 0, 0, 0, 0
        self.bad = self.holds = False
        self.words: set[str] = set()


class _Open:
    """The elements that are open, from the root on, and where each tag and the last block are among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, at: int) -> None:
        """Close the element at a place and all within; the root stays."""
        while len(self.stack) > max(1, at):
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at > 0 and (tag in _BLOCK or at > self.blocks[-1]):  # an inline end tag does not close blocks
            self.close(at)

    def room(self, tag: str) -> None:
        """Close what a start tag ends without saying so."""
        if tag in _CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in _ENDS:
            own, holders = _ENDS[tag]
            at = self.last(*own)
            if at > self.last(*holders):
                self.close(at)


_CELL = (("td", "th"), ("tr", "table"))
_ITEM = (("dt", "dd"), ("dl",))
#: What a start tag ends, and what holds it back.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": _ITEM, "dd": _ITEM, "td": _CELL, "th": _CELL, "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}


def parse(page: str) -> Node:
    """The tree of a page; text is decoded."""
    root = Node("html", "", None)
    own = _Open(root)
    at = 0

    def put(text: str) -> None:
        if text:
            own.stack[-1].kids.append(html.unescape(text) if "&" in text else text)

    while m := _TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            put(html.escape(m[1], False))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            own.end(tag)
            continue
        if tag in ("html", "body") and own.at.get(tag):
            continue
        own.room(tag)
        new = Node(tag, m[4], own.stack[-1])
        own.stack[-1].kids.append(new)
        if tag in _VOID or m[4].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        own.push(new)
    put(page[at:])
    return root


def _path(node: Node | None):
    while node is not None:
        yield node
        node = node.up


def _named(node: Node) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(node.attrs)} if node.attrs.strip() else {}


def _mark(root: Node) -> None:
    """Flag boilerplate and weigh text, from the leaves up."""
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    while stack:
        n, link, inside, done = stack.pop()
        if done:
            for k in n.kids:
                if isinstance(k, str):
                    size = len(k) - k.count(" ") + len(k.split()) if k.strip() else 0
                    n.chars += size
                    n.linked += size if link else 0
                    n.commas += k.count(",") + k.count("，") + k.count("、")
                elif not k.bad:
                    n.chars += k.chars
                    n.linked += k.linked
                    n.links += k.links + (k.tag == "a")
                    n.commas += k.commas
                    n.holds = n.holds or k.holds
            n.holds = n.holds or n.tag in ("article", "main")
            n.bad = bool(n.words & _COMMENTS) and not n.holds and n.tag not in ("html", "body")
            continue
        named = _named(n)
        n.words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(named.get(k, ""))}
        n.bad = (
            n.tag in _DROP
            or (n.tag == "header" and not inside)
            or named.get("role", "").lower() in _ROLES
            or "hidden" in named
            or named.get("aria-hidden") == "true"
            or bool(_HIDDEN.search(named.get("style", "")))
        )
        if n.bad:
            continue
        link = link or n.tag == "a"
        stack.append((n, link, inside, True))
        inside = inside or n.tag in ("article", "main", "section")
        stack += [(k, link, inside, False) for k in n.kids if isinstance(k, Node)]


def _weigh_names(root: Node) -> None:
    """Flag blocks that their names tell as no part of an article and that are a minor part of the page's text."""
    for n in _nodes(root):
        for k in n.kids:
            if not isinstance(k, Node) or k.bad or k.holds or k.tag in ("html", "body") or k.words & {"article", "main", "content", "entry", "post", "story"}:
                continue
            strong, mild = bool(k.words & _STRONG), bool(k.words & _MILD) and k.tag not in _PROSE
            if (strong or mild) and k.chars * (2 if strong else 3) < root.chars + 1:
                k.bad = True


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _nodes(root: Node):
    stack = [root]
    while stack:
        n = stack.pop()
        if not n.bad:
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]


def _score(root: Node) -> None:
    for n in reversed(list(_nodes(root))):  # each after all below it
        own = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        leaf = n.tag in _LEAVES
        points = 0.0
        if n.chars >= 2 and (leaf or (n.tag in ("div", "section", "article", "main", "body") and own >= 25)):
            points = (1 + min(n.chars / 100, 10) + n.commas) * (1 - _density(n))
        if not leaf:
            n.score += points
        if n.up is not None:
            n.up.score += n.score * (0.5 if n.tag in _BLOCK else 1) + (points if leaf else 0)
        # the names weigh on the container alone, not on what it passes on
        named = _named(n)
        if n.tag in ("article", "main") or named.get("role", "").lower() in ("main", "article") or named.get("itemprop") == "articleBody":
            n.score = n.score * 1.5 + 10
        elif n.tag in ("div", "section") and n.score and _GOOD_WORDS & n.words:
            n.score = n.score * 1.2 + 5
        elif n.tag in ("ul", "ol", "dl", "table", "tr", "li", "tbody"):
            n.score *= 0.7
        if n.words & (_STRONG | _MILD) and not n.holds:
            n.score *= 0.6


def _container(root: Node) -> list[Node]:
    """The best container with the siblings that are kept, in page order."""
    best = max((n for n in _nodes(root) if n.tag in _BLOCK and n.tag not in ("html", "p")), key=lambda n: n.score * (1 - _density(n)), default=root)
    if best.score <= 0 or best.up is None:
        return [root]
    # an article that holds the best container is taken whole
    for n in _path(best.up):
        if n.tag in ("article", "main") and n.chars and best.chars >= 0.5 * n.chars:
            best = n
    told = best.tag in ("article", "main")
    kept = []
    for k in best.up.kids:
        if not isinstance(k, Node) or k.bad:
            continue
        scored = k.tag in _BLOCK and k.score * (1 - _density(k)) >= 0.2 * best.score and _density(k) < 0.5
        prose = k.tag in ("p", "pre", "blockquote") and (k.chars >= 80 and _density(k) < 0.25 or not told and k.chars > 0 and _density(k) < 0.5)
        other = not told and k.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "math") and k.chars > 0 and _density(k) < 0.5
        if k is best or scored or prose or other:
            kept.append(k)
    return kept


def _links_only(n: Node) -> bool:
    """A list or block that is a menu: several short links and hardly anything else."""
    return n.tag in ("ul", "ol", "dl", "div", "table", "section", "p") and n.links >= 3 and _density(n) > 0.8 and n.linked < 40 * n.links


def _blocks(nodes: list[Node]) -> list[str]:
    told = any(n.tag in ("article", "main") for n in nodes)
    out: list[str] = []
    part: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            out.append(text)

    for top in nodes:
        end()
        stack: list[Node | str | None] = [top]
        while stack:
            k = stack.pop()
            if k is None:
                end()
            elif isinstance(k, str):
                part.append(k)
            elif k.bad or not told and _links_only(k):
                continue
            elif k.tag in ("br", "wbr", "img"):
                part.append("" if k.tag == "wbr" else " ")
            else:
                if block := k.tag in _BLOCK:
                    end()
                stack += [*([None] if block else []), *reversed(k.kids)]
    end()
    return out


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    _mark(root)
    _weigh_names(root)
    _score(root)
    return "\n".join(_blocks(_container(root)))


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE: dict[str, str] = {}
