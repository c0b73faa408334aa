"""Operator 7, HTML extraction by tree scoring.

A page becomes a tree of elements. Each text block passes points for its length and commas to its ancestors, in full to its parent and
by half at each step further up, and an element's points are discounted by its link density. The element with the most points marks the place;
the main container is the outermost article around it, else the outermost main, else what is reached by climbing while the parent is marked as
content or adds text that isn't link-dense (to the body only from pieces of running text, such as lists or tables). The container's text is kept
whole, with siblings that have a good share of the best element's points. After an article or main only further
articles and paragraphs count as siblings. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
cut off as whole subtrees, by tag, role or names in class and id. A name counts as a whole: all its words must be unwanted or say nothing of
the content ("site-header", not "page-with-sidebar" or "related-work"); elements whose names hold an unwanted word among others go if more than
half of their text is linked. What holds the page's main text stays, whatever its name or tag (a form around the article); readers' discussions go
where they follow the text outside of an article. Attributes are read by HTML's rules.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one line break
in page order. Nulls and edge cases: null or empty html gives an empty text; a page without markup gives its text; unclosed elements
end where HTML's rules end them; rows with null or repeated page_ids each give a row; extra columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What starts with "<" and isn't text: comments, declarations and such (they end at the first ">"), tags.
MARKUP = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*+"
#: By HTML's rules a quote delimits a value only at its start; one that is never closed belongs to an unquoted value.
TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE}))?+)*+)>", re.A)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE}))?+", re.A)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements by what HTML and readers take them for.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
DROPPED = RAW | {"head", "button", "select", "input", "dialog", "svg", "object", "embed", "canvas", "video", "audio", "annotation", "annotation-xml"}
#: Left out unless they hold the page's main text.
SUSPECT = {"nav", "header", "footer", "aside", "form", "label", "fieldset", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MATH = {"math", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "output", "picture", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | MATH
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
UNWANTED = COMMENTS | {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "promoted", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
ROLES = {"alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words that leave a name's meaning as it is: "site-header" is a header, "page-with-sidebar" no sidebar, "related-work" nothing of the kind.
NEUTRAL = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "global", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "stories", "top", "unit", "widgets", "wrap", "wrapper"}
#: Names of what readers add when it follows the text outside of an article; within one they are ordinary parts.
AFTER = {"conversation", "discussion", "discussions", "responses", "reviews", "thread"}
GOOD = {"article", "main", "content", "post", "entry", "story", "body", "text"}
#: Pieces of running text: none of them is a page's main container while others stand beside it.
FLOW = {"blockquote", "pre", "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "details", "section"}
KEEP_SHARE, BONUS, LINKED = 0.2, 25.0, 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "good", "points", "chars", "linked", "order", "suspect", "mixed", "remarks", "after", "within")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, good: bool, order: int):
        self.tag, self.parent, self.dropped, self.good, self.order = tag, parent, dropped, good, order
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        # suspect: left out unless it holds the main text; mixed: a name with an unwanted word among others, so its links decide; remarks: by readers
        self.suspect = self.mixed = self.remarks = self.after = False
        self.within: Node | None = None

    def mark(self, attributes: str, in_article: bool) -> None:
        """Take in what class, id, role and style say."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or ""
            found.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1] == value[0] and len(value) > 1 else value))
        role = found.get("role", "").lower().split()
        self.good = self.good or "main" in role
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            self.dropped = True
        self.suspect = self.suspect or bool(ROLES & set(role))
        for name in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = {w.lower() for w in WORD.findall(name)}
            self.good = self.good or bool(words & GOOD)
            if self.tag in ("article", "main"):
                self.remarks = self.remarks or bool(words) and words <= COMMENTS
            elif words & UNWANTED:
                whole = words <= UNWANTED | NEUTRAL
                self.remarks = self.remarks or whole and bool(words & COMMENTS)
                self.suspect, self.mixed = self.suspect or whole, self.mixed or not whole
            self.after = self.after or bool(words & AFTER) and words <= AFTER | NEUTRAL and not in_article
        self.dropped = self.dropped or self.remarks


def parse(page: str) -> list[Node]:
    """All elements in the order of their start tags; the first is the root. Time follows the page's length: open tags are counted, so that only walks that close something are made."""
    root = node = Node("", None, False, False, 0)
    nodes, opened = [root], Counter()
    at, order = 0, 0

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    while at < len(page):
        m = MARKUP.search(page, at)
        if not m:
            break
        start, token = m.start(), m[0]
        tagged = None if token in ("<!--", "<!", "<?") else TAG.match(page, start)
        if tagged:
            end = tagged.end()
        elif token == "<!--":
            end = COMMENT.match(page, start).end()
        elif token[-1] in "!?/" and not page[start + 2 : start + 3].isalpha() or token in ("<!", "<?"):
            end = page.find(">", start) + 1 or len(page)
        else:
            break  # a tag that the page's end cuts off
        if start > at:
            node.children.append(page[at:start])
        at = end
        if not tagged:
            continue
        token, tag = tagged[0], tagged[1].lower()
        if token[1] == "/":
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in ENDS_P and opened["p"]:
            up = node
            while up.parent is not None and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                leave(up.parent)
        if tag in ENDS_SAME and any(opened[x] for x in ENDS_SAME[tag]):
            up = node
            while up.parent is not None and up.tag not in ENDS_SAME[tag] and up.tag not in WITHIN[tag]:
                up = up.parent
            if up.tag in ENDS_SAME[tag]:
                leave(up.parent)
                if tag == "tr" and up.tag != "tr" and node.tag == "tr":
                    leave(node.parent)
        if tag == "body" and node.tag == "head":
            leave(node.parent)
        order += 1
        child = Node(tag, node, tag in DROPPED, tag in ("article", "main"), order)
        child.suspect = tag in SUSPECT
        if tagged[2] and not child.dropped and tag not in ("html", "body", "a", "img"):
            child.mark(tagged[2], opened["article"] > 0 or tag == "article")
        node.children.append(child)
        nodes.append(child)
        if tag not in VOID and not token.endswith("/>"):
            node = child
            opened[tag] += 1
    if at < len(page):
        node.children.append(page[at:])
    return nodes


def _settle(nodes: list[Node]) -> None:
    """Drop what is suspect, unless it holds the main text: an article or main longer than all text beside suspects, or, for a form, such running text of its own. Of mixed names, those full of links go."""
    for n in nodes[1:]:
        n.dropped = n.dropped or n.parent.dropped
        n.within = n.parent if n.parent.suspect else n.parent.within
    for n in reversed(nodes):
        if n.dropped:
            continue
        n.chars += sum(len(x.strip()) for x in n.children if isinstance(x, str))
        if n.tag == "a":
            n.linked = n.chars
        n.dropped = n.mixed and n.linked > LINKED * n.chars
        if n.parent is not None and not n.suspect and not n.dropped:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    beside = nodes[0].chars - nodes[0].linked
    plain = lambda n: n.chars - n.linked
    inside = [n for n in nodes if not n.dropped and n.within is not None and n.tag in ("article", "main")]
    if not inside:
        inside = [n for n in nodes if not n.dropped and n.tag == "form" and any(isinstance(x, Node) and not x.dropped and not x.suspect for x in n.children)]
    best = max(inside, key=lambda n: (plain(n), -n.order), default=None)
    if best is not None and plain(best) > beside:
        up: Node | None = best
        while up is not None:
            up.suspect = False
            up = up.within
    for n in nodes:
        n.dropped = n.dropped or n.suspect
        n.chars = n.linked = 0


def _blocks(top: list[Node | str], out: list[tuple[Node | None, str, int]]) -> None:
    """Text blocks under the nodes in page order: (the block element, its text, linked characters in it)."""
    stack: list[tuple[Node | str | None, Node | None, bool]] = [(x, None, False) for x in reversed(top)]
    words: list[str] = []
    linked = 0
    owner: Node | None = None

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            out.append((owner, text, linked))
        words.clear()
        linked = 0

    while stack:
        x, own, link = stack.pop()
        if x is None:
            flush()
            owner = own
        elif isinstance(x, str):
            words.append(x)
            if link:
                linked += len(x.strip())
        elif x.dropped:
            continue
        elif x.tag == "br":
            words.append(" ")
        elif x.tag in INLINE:
            stack.extend((c, own, link or x.tag == "a") for c in reversed(x.children))
        else:
            flush()
            stack.append((None, own, link))
            stack.extend((c, x, link) for c in reversed(x.children))
            owner = x
            continue
    flush()


def _container(best: Node) -> Node:
    """The element around best whose text belongs together."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for tag in ("article", "main"):
        found = [x for x in above if x.tag == tag]
        if found:
            return found[-1]
    top = best
    for up in above[1:]:
        if up.tag in ("", "html") or up.tag == "body" and top.tag not in FLOW:
            break
        if not up.good and up.linked - top.linked >= LINKED * max(1, up.chars - top.chars):
            break
        top = up
    return top


def _score(n: Node) -> float:
    return (n.points + BONUS * n.good) * (1 - min(1.0, n.linked / n.chars if n.chars else 0.0))


def _best(nodes: list[Node]) -> Node | None:
    """The element with the most points; points and lengths stay in the nodes."""
    root = nodes[0]
    for n in nodes:
        n.points, n.chars, n.linked = 0.0, 0, 0
    blocks: list[tuple[Node | None, str, int]] = []
    _blocks(root.children, blocks)
    touched: dict[int, Node] = {}
    for owner, text, linked in blocks:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        node, share = (owner.parent or owner) if owner is not None and owner.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "th") else (owner or root), 1.0
        here = owner or root
        here.chars += len(text)
        here.linked += linked
        while node is not None and share > 0.05:
            node.points += points * share
            touched[id(node)] = node
            node, share = node.parent, share / 2
    for n in reversed(nodes[1:]):  # an element stands after those around it
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    found = [n for n in touched.values() if n.tag not in ("", "html")] or list(touched.values())
    if not found:
        return None
    return max(found, key=lambda n: (_score(n), -n.order))


def main_text(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    nodes = parse(page)
    _settle(nodes)
    best = _best(nodes)
    if best is None:
        return ""
    up: Node | None = best
    while up is not None and not up.after:
        up = up.parent
    if up is None and (late := [n for n in nodes if n.after and n.order > best.order]):
        for n in late:
            n.dropped = True
        best = _best(nodes)
    top = _container(best)
    kept: list[Node | str] = [top]
    if top.parent is not None and top.tag not in ("body", "html"):
        least = KEEP_SHARE * _score(best)
        kept, passed = [], False
        for x in top.parent.children:
            if x is top:
                kept.append(x)
                passed = top.tag in ("article", "main")
            elif passed and isinstance(x, Node) and x.tag not in ("article", "p"):
                continue  # what follows an article isn't part of it
            elif isinstance(x, Node) and not x.dropped and x.chars:
                density = x.linked / x.chars
                if _score(x) >= least and density < 0.5 or x.tag == "p" and x.chars > 80 and density < 0.25:
                    kept.append(x)
    out: list[tuple[Node | None, str, int]] = []
    _blocks(kept, out)
    return "\n".join(text for _, text, _ in out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.slice(at, 64)
                texts = [main_text(x) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
