"""Main text of web pages by tag-path ratios.

A page's blocks of text are grouped by their path of tags from the root. For each path the characters and the
punctuation of its blocks are added up and divided by the number of blocks: menus and captions share paths with many short blocks,
an article's paragraphs share one with long, punctuated ones. Both ratios are smoothed over the paths in page order, fused into
one by their product, and the blocks on paths above a share of the spread are content. The innermost element that holds
most of the content is the article, with its headings and short paragraphs, however low their own ratio (see `select`).
Names only remove: elements that are never part of an article (menus, footers, asides, forms, scripts), and those whose
class, id or role says so, unless they hold the article or most of the content.

What happens in each case: null, empty and text-free pages give the empty text; markup that is cut off or not closed is
read as far as it goes; a page without markup is one block; repeated rows are read each
for itself; an empty table gives an empty result; null ids and urls are kept; further columns are ignored, whatever their names. Pages
are read whole, in time and memory proportional to their length, however deep they nest or whatever is not closed.
"""

from __future__ import annotations

import html as html_library
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, workers_can_import

#: Fixed values of HTML: elements without content, elements whose content is no markup, elements that form blocks, and the
#: elements that end when one of them begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = BLOCK - {"body", "html", "option", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that are never part of an article, and words in class, id and role that say the same.
NEVER = frozenset("nav footer aside form script style noscript template head title iframe object svg canvas button select textarea dialog audio video menu search xmp noembed noframes".split())
BOILERPLATE = re.compile(
    r"(?i)(^|[\s_-])(ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|"
    r"comments?|commentlist|respond|disqus|replies|reactions?|nav|navbar|navigation|menu|menus|breadcrumbs?|pagination|pager|sidebar|side-bar|widget\w*|aside|complementary|contentinfo|footer|foot|masthead|topbar|site-header|page-header|"
    r"header|related|recommend\w*|more-stories|trending|popular|share|sharing|social|follow|tags|tag-list|toolbar|search|skip-link|skip|disclaimer|copyright|legal|paywall|outbrain|taboola|feedback)($|[\s_-])"
)
ARTICLE = re.compile(r"(?i)(^|[\s_-])(article|articlebody|article-body|post-content|entry-content|post-body|story-body|content-body|main-content|main)($|[\s_-])")
#: Names that mean the same wherever they stand; others may also be an article's own words, as in `share-price` or `legal`.
SURELY = re.compile(
    r"(?i)(^|\s)((ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|nav\w*|menus?|breadcrumbs?|pagination|pager|sidebar|widget|aside|"
    r"complementary|contentinfo|footer|masthead|related|share|sharing|social|outbrain|taboola)|(ads?|advert\w*|sponsor\w*|promo|cookies?|newsletter|comments?|sidebar|nav|menu|breadcrumbs?|footer|related|social|outbrain|taboola)[_-]\S+)($|\s)"
)
#: Parts of a name that say how the page is laid out, not what the element is.
LAYOUT = re.compile(r"(?i)(^|\s)(?:\S*[_-])?(has|no|with|without)-\S+|(^|\s)(article|entry|post|story|content)[_-]header(?=$|\s)|(^|\s)\S+[_-](wrap|wrapper|container|layout|inner|outer|row|grid|page)(?=$|\s)")
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?)*+)(?:>|$)", re.S,
)
ATTRIBUTE = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|itemprop|aria-hidden|hidden|style)(?![^\s=/>])(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>][^\s>]*))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: Elements that hold running text, so that none of them is an article of its own.
LEAVES = HEADINGS | frozenset("p pre li dt dd caption figcaption legend summary address tr td th option".split())

#: Where no element says that it is the article, the one that holds this share of the content is.
MAJORITY = 0.5


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: int  # number of the tag path from the root
    out: bool = False  # inside something that is never part of an article
    marked: bool = False  # says that it holds the article
    named: bool = False  # its class, id or role says that it is no part of an article, which what it holds may belie
    surely: bool = False  # and in words that mean nothing else


@dataclass(slots=True)
class Block:
    node: int
    text: str
    linked: int  # characters inside links

    @property
    def chars(self) -> int:
        return max(0, len(self.text) - 2 * self.linked)


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html_library.unescape((m[2] or "").strip("\"'")))
    return found


def _names_boilerplate(names: str) -> bool:
    return bool(BOILERPLATE.search(names) and BOILERPLATE.search(LAYOUT.sub(" ", names)))


class _Reader:
    """Reads a page tag by tag: keeps the open block elements, and the text since the last bound of a block."""

    def __init__(self) -> None:
        self.page = Page([Node("", -1, 0)])
        #: The open elements, and where the ones of each tag stand among them.
        self.stack, self.open, self.paths = [0], {}, {}
        self.parts, self.linked, self.in_link = [], 0, False
        #: The inline element that is hidden or named, how deep it nests, whether it is hidden; letters in and out of such.
        self.inline, self.depth, self.hidden, self.set_apart, self.plain = "", 0, False, 0, 0

    @property
    def top(self) -> Node:
        return self.page.nodes[self.stack[-1]]

    def text(self, text: str) -> None:
        if self.top.out or self.inline and self.hidden:
            return
        if "&" in text:
            text = html_library.unescape(text)
        self.parts.append(text)
        n = len(text.strip())
        if self.in_link:
            self.linked += n
        if self.inline:
            self.set_apart += n
        else:
            self.plain += n

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            # A block that is nothing but elements named otherwise (a span of sharing links) is none of the article's.
            if text and (self.plain or not self.set_apart):
                self.page.blocks.append(Block(self.stack[-1], text, self.linked))
        self.parts, self.linked, self.inline, self.depth, self.set_apart, self.plain = [], 0, "", 0, 0, 0

    def pop_to(self, names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of these names, unless one of the stops is met before."""
        last = lambda tags: max((self.open[x][-1] for x in tags if self.open.get(x)), default=0)
        k = last(names)
        if k <= last(stops):
            return
        self.close_block()
        for gone in self.stack[k:]:
            self.open[self.page.nodes[gone].tag].pop()
        del self.stack[k:]

    def end(self, tag: str) -> None:
        if tag == self.inline:
            self.depth -= 1
            if not self.depth:
                self.inline = ""
        if tag == "a":
            self.in_link = False
        elif tag == "br" or tag == "p" and not self.open.get("p"):
            self.parts.append(" ")
        elif tag in BLOCK or tag in NEVER:
            self.pop_to((tag,))

    def begin(self, tag: str, raw: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.pop_to(("p",), ("body", "article", "div", "section", "td", "li"))
                self.close_block()
            elif tag == "br":
                self.text(" ")
            return
        if tag == "a":
            self.in_link = True
        if tag not in BLOCK and tag not in NEVER:
            self.begin_inline(tag, raw)
            return
        if tag in ENDS_P:
            self.pop_to(("p",), ("td", "th", "li", "div", "section", "article", "table", "body", "blockquote"))
        if tag in ENDS_BEFORE:
            self.pop_to(ENDS_BEFORE[tag], STOPS[tag])
        self.close_block()
        above = self.top
        attributes = _attributes(raw) if raw else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
        article = tag in ("article", "main") or bool(ARTICLE.search(f"{names} {attributes.get('itemprop', '')}"))
        plain = tag not in ("html", "body", "article", "main") and not (tag == "header" and self.open.get("article"))
        named = plain and tag not in NEVER and tag != "header" and _names_boilerplate(names)
        # A comment often is an article in an article.
        out = above.out or tag in NEVER or _is_hidden(attributes) or plain and tag == "header" or tag == "article" and bool(self.open.get("article"))
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
        self.page.nodes.append(Node(tag, self.stack[-1], path, out, article and not out, named and not out, named and bool(SURELY.search(LAYOUT.sub(" ", names)))))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.page.nodes) - 1)

    def begin_inline(self, tag: str, raw: str) -> None:
        if raw.rstrip().endswith("/"):
            return
        if self.inline:
            self.depth += tag == self.inline
            return
        attributes = _attributes(raw) if raw else {}
        hidden = _is_hidden(attributes)
        if hidden or attributes and tag not in ("a", "b", "i", "em", "strong") and _names_boilerplate(f"{attributes.get('class', '')} {attributes.get('id', '')}"):
            self.inline, self.depth, self.hidden = tag, 1, hidden


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def parse(source: str) -> Page:
    """The tree of a page's block elements, and the blocks of text of those in page order."""
    reader, at, end = _Reader(), 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        start = m.start() if m else end
        if start > at:
            reader.text(source[at:start])
        if not m:
            break
        at = max(m.end(), start + 1)
        if m[1] is not None:
            reader.text(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            reader.end(tag)
        elif tag in RAW:
            stop = _end_of(tag).search(source, at)
            at = stop.end() if stop else end
        else:
            reader.begin(tag, m[4])
    reader.close_block()
    return reader.page


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def ratios(page: Page, smooth: float = 1.0) -> dict[int, float]:
    """The fused, smoothed ratio of each tag path outside of what is never part of an article."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in page.blocks:
        path = page.nodes[b.node].path
        chars[path] = chars.get(path, 0) + b.chars
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(b.text))
        count[path] = count.get(path, 0) + 1
    paths = list(chars)
    n = np.array([count[p] for p in paths], float)
    by_chars, by_marks = np.array([chars[p] for p in paths]) / n, np.array([marks[p] for p in paths]) / n
    if len(paths) > 1:
        window = np.exp(-0.5 * (np.arange(-2, 3) / smooth) ** 2)
        window /= window.sum()
        by_chars, by_marks = (0.8 * x + 0.2 * np.convolve(np.pad(x, 2, mode="edge"), window, "valid") for x in (by_chars, by_marks))
    return dict(zip(paths, (by_chars * (1 + by_marks)).tolist(), strict=True))


def content_paths(page: Page, spread: float = 0.5) -> set[int]:
    """The paths whose fused ratio reaches the threshold: a share of the ratios' spread."""
    fused = ratios(page)
    values = np.array(list(fused.values()))
    limit = min(spread * values.std(), values.max()) if fused else 0.0
    return {p for p, v in fused.items() if v >= limit}


def _below(page: Page, weights: Iterable[tuple[int, int]]) -> list[int]:
    """What each element weighs with all that it holds, by the (element, weight) of each block."""
    weight = [0] * len(page.nodes)
    for k, n in weights:
        weight[k] += n
    for k in range(len(weight) - 1, 0, -1):
        weight[page.nodes[k].parent] += weight[k]
    return weight


def _leave_out_named(page: Page, weight: list[int], most: float = 0.5, some: float = 0.25) -> None:
    """Leaves out the elements whose names say so, by what content they hold. If no article stands outside of them, none
    goes that holds the longest article, if that has some of the content; if there is no such article either, none that
    holds most of the content. Within an article a name that may be a word of its own removes only what holds no content."""
    nodes = page.nodes
    below = [False] * len(nodes)
    for k in range(1, len(nodes)):
        below[k] = nodes[k].named or below[nodes[k].parent]
    articles = [k for k, x in enumerate(nodes) if x.tag in ("article", "main") and not x.out]
    texts = _below(page, ((b.node, len(b.text)) for b in page.blocks))
    free = any(texts[k] and not below[k] for k in articles)
    at = 0 if free else max((k for k in articles if weight[k] >= some * weight[0]), key=lambda k: weight[k], default=0)
    whole = not free and not at
    holds = {0}
    while at:
        holds.add(at)
        at = nodes[at].parent
    within = [False] * len(nodes)
    for k in range(1, len(nodes)):
        x = nodes[k]
        within[k] = within[x.parent] or nodes[x.parent].marked
        own = within[k] and not x.surely and weight[k] > 0
        x.out = x.out or nodes[x.parent].out or x.named and not own and k not in holds and not (whole and weight[k] > most * weight[0])
        x.marked = x.marked and not x.out


def select(page: Page, spread: float = 0.5, cover: float = 0.7) -> list[Block]:
    """The blocks of a page's article, in page order.

    Content are the blocks whose path reaches the threshold. Around them the article is the innermost element, but none of
    running text, that holds `cover` of the content's characters. Of what it holds all blocks are the article's but
    lists of links that no content surrounds: before its first content or heading, or after its last content and not
    beside any. Elements elsewhere that hold content on the same paths, as much in a block on average as the threshold
    asks of a path, are further parts of it.
    """
    nodes, paths = page.nodes, content_paths(page, spread)
    content = [b for b in page.blocks if nodes[b.node].path in paths]
    _leave_out_named(page, _below(page, ((b.node, b.chars) for b in content)))
    found = [b for b in page.blocks if not nodes[b.node].out]
    content = [b for b in found if nodes[b.node].path in paths] or found
    weight = _below(page, ((b.node, b.chars) for b in content))
    if not any(x.marked for x in nodes):
        cover = min(cover, MAJORITY)
    root = max((k for k, x in enumerate(nodes) if x.tag not in LEAVES and weight[k] >= cover * weight[0]), default=0)
    roots = {root}
    inside = _inside(page, roots)
    main = {nodes[b.node].path for b in content if inside[b.node]}
    #: Of each element outside that directly holds blocks on those paths: how many, and their characters.
    further: dict[int, list[int]] = {}
    for b in content:
        if nodes[b.node].path in main and not inside[b.node]:
            up = nodes[b.node].parent if nodes[b.node].tag in LEAVES else b.node
            further.setdefault(up, []).append(b.chars)
    typical = weight[root] / max(1, sum(inside[b.node] for b in content))
    roots |= {k for k, chars in further.items() if k and sum(chars) / len(chars) >= spread * typical}
    inside = _inside(page, roots)
    kept = [b for b in found if inside[b.node]]
    ids = {id(b) for b in content}
    at = [k for k, b in enumerate(kept) if id(b) in ids]
    first = min((k for k, b in enumerate(kept) if id(b) in ids or nodes[b.node].tag in HEADINGS), default=0)
    last, beside = max(at, default=len(kept)), {nodes[b.node].parent for b in content}
    lists: dict[int, list[int]] = {}
    for b in kept:
        if nodes[b.node].tag == "li":
            n = lists.setdefault(nodes[b.node].parent, [0, 0])
            n[0] += len(b.text)
            n[1] += b.linked
    menus = {k for k, (chars, linked) in lists.items() if linked > 0.8 * chars}
    is_menu = lambda k, b: nodes[b.node].tag == "li" and nodes[b.node].parent in menus and (k < first or k > last and nodes[nodes[b.node].parent].parent not in beside)
    return [b for k, b in enumerate(kept) if not is_menu(k, b)]


def _inside(page: Page, roots: set[int]) -> list[bool]:
    """Whether each element is one of the roots or lies in one."""
    held = [False] * len(page.nodes)
    for k, x in enumerate(page.nodes):
        held[k] = k in roots or x.parent >= 0 and held[x.parent]
    return held


def main_text(source: str | None, spread: float = 0.5, cover: float = 0.7) -> str:
    """The main text of one page: its blocks, joined by blank lines."""
    return "\n\n".join(b.text for b in select(parse(source), spread, cover)) if source and source.strip() else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    workers_can_import(pages.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
