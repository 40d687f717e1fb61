"""HTML expressions, and the small parser behind nested link extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from html.parser import HTMLParser

from pyspark.sql import Column, functions as F

from ..config import NAV_LEVELS, NAV_MARKERS, NAV_TAGS
from .text import py_words

#: Elements that never have content (fixed by HTML).
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose text is no page text.
HIDDEN_TEXT_TAGS = frozenset(("script", "style", "template"))
#: Elements whose content the parser may read by rules of its own.
_OWN_CONTENT = frozenset("iframe noembed noframes noscript plaintext script style svg math template textarea xmp".split())
#: A tag in its plainest form and the text behind it, and the attributes of such a tag.
_PLAIN_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z]+="[^"<>&]*")*)>([^<&]*)')
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def html_h1(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<h1[^>]*>([^<]*)</h1>", 1)


def html_text(html: Column) -> Column:
    """Page text: scripts, styles, comments and tags replaced by blanks."""
    hidden = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(hidden, r"(?s)<[^>]*>", " ")


def html_word_count(html: Column) -> Column:
    return F.size(py_words(html_text(html)))


def clean_html(html: Column, limit: int | None = None) -> Column:
    """The body without scripts, styles and noscript blocks; the whole page where it has no body."""
    visible = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", "")
    body = F.regexp_extract(visible, r"(?is)(<body\b.*</body>)", 1)
    kept = F.when(body == "", visible).otherwise(body)
    return F.substring(kept, 1, limit) if limit else kept


def plain_tokens(html: str) -> list[tuple[str, str, str, str]] | None:
    """``(slash, tag, attributes, text behind)`` of a page that is only plain tags and text; nothing for any other page.

    Such a page has no references, comments, declarations or elements with rules of their own, so one search reads it as
    ``HTMLParser`` does, several times faster. The lengths tell whether all of it was read.
    """
    first = html.find("<")
    tokens = _PLAIN_TAG.findall(html, first) if first >= 0 else []
    if not tokens or "&" in html or sum([len(a) + len(b) + len(c) + len(d) for a, b, c, d in tokens]) + 2 * len(tokens) + first != len(html):
        return None
    names = [t[1] for t in tokens]
    if not _OWN_CONTENT.isdisjoint(names) or any(a and c for a, _, c, _ in tokens):
        return None
    # a title is read to its end tag, whatever stands in it
    if "title" in names and any(b == "title" and not a and after[:2] != ("/", "title") for (a, b, _, _), after in zip(tokens, [*tokens[1:], ()])):
        return None
    return tokens


class _Element:
    __slots__ = ("tag", "nav", "zone", "first_text", "links", "href")

    def __init__(self, tag, nav, zone, first_text, href=None):
        self.tag, self.nav, self.zone, self.first_text, self.href = tag, nav, zone, first_text, href
        self.links = []


class LinkScanner(HTMLParser):
    """Collects the links of one page with their text, context and place in the page.

    An end tag closes everything opened since its start tag; one without a start tag is ignored.
    """

    def __init__(self, zone_tags=("main", "article", "section"), zone_classes=(), context_chars=100):
        super().__init__(convert_charrefs=True)
        self.zone_tags, self.zone_classes = frozenset(zone_tags), frozenset(zone_classes)
        self.context_chars = context_chars

    def scan(self, html: str) -> list[dict]:
        self.reset()
        self.texts: list[str] = []
        self.pending: list[str] = []
        self.stack = [_Element("", False, False, 0)]
        self.links: list[dict] = []
        tokens = plain_tokens(html)
        if tokens is not None:
            return self._scan_plain(html, tokens)
        self.feed(html)
        self.close()
        self._end_text()
        self._close_down_to(0)
        return self.links

    def _scan_plain(self, html, tokens):
        """The links of a plain page: what the handlers below do, in one loop."""
        texts, links, stack = self.texts, self.links, [("", False, -NAV_LEVELS, 0)]  # tag, in a zone, depth of the next navigation outwards, first text
        waiting = []  # depth of the element at whose end it is known, link, whether its text or its context: depths never fall
        piece = html[: html.find("<")].strip()
        if piece:
            texts.append(piece)

        def close_down_to(depth):
            while waiting and waiting[-1][0] >= depth:
                at, link, use = waiting.pop()
                link[use] = "".join(texts[stack[at][3] :]) if use == "text" else self._context(stack[at][3])
            del stack[depth:]

        for slash, tag, written, text in tokens:
            depth = len(stack)
            if slash:
                at = depth - 1
                while at and stack[at][0] != tag:
                    at -= 1
                if at:
                    close_down_to(at)
            elif tag not in VOID_TAGS:
                _, zone, nav_at, _ = stack[-1]
                inside = zone or tag in self.zone_tags
                mine = depth if tag in NAV_TAGS else nav_at
                href = None
                if written:
                    attrs = dict(_PLAIN_ATTRIBUTE.findall(written))
                    href = attrs.get("href") if tag == "a" else None
                    if "class" in attrs or "id" in attrs:
                        marked, in_class = self._marked(tag, attrs)
                        mine, inside = depth if marked else mine, inside or in_class
                if href is not None:
                    link = {"href": href, "in_zone": zone, "in_nav": depth - 1 - nav_at < NAV_LEVELS}
                    links.append(link)
                    waiting += [(depth - 1, link, "context"), (depth, link, "text")]
                stack.append((tag, inside, mine, len(texts)))
            piece = text.strip()
            if piece:
                texts.append(piece)
        close_down_to(0)
        return links

    def _marked(self, tag, attrs):
        """Whether class or id mark an element as navigation, and its class as a content zone."""
        marks = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        return any(m in marks for m in NAV_MARKERS), tag == "div" and not self.zone_classes.isdisjoint(attrs.get("class", "").split())

    def handle_starttag(self, tag, attrs):
        self._end_text()
        if tag in VOID_TAGS:
            return
        # an element within a zone counts as one
        nav, zone = tag in NAV_TAGS, self.stack[-1].zone or tag in self.zone_tags
        attrs = {k: v or "" for k, v in attrs} if attrs else {}
        if "class" in attrs or "id" in attrs:
            marked, in_class = self._marked(tag, attrs)
            nav, zone = nav or marked, zone or in_class
        self.stack.append(_Element(tag, nav, zone, len(self.texts), attrs.get("href") if tag == "a" else None))
        if self.stack[-1].href is not None:
            around = self.stack[:-1]
            link = {
                "href": self.stack[-1].href,
                "in_zone": around[-1].zone,
                "in_nav": any(e.nav for e in around[-NAV_LEVELS:]),
            }
            self.links.append(link)
            self.stack[-1].links.append(("text", link))
            around[-1].links.append(("context", link))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close_down_to(i)
                break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._end_text()

    def _end_text(self):
        if not self.pending:
            return
        piece = "".join(self.pending).strip()
        self.pending.clear()
        if piece and self.stack[-1].tag not in HIDDEN_TEXT_TAGS:
            self.texts.append(piece)

    def _close_down_to(self, i):
        for element in reversed(self.stack[i:]):
            for use, link in element.links:
                if use == "text":
                    link["text"] = "".join(self.texts[element.first_text :])
                else:
                    link["context"] = self._context(element.first_text)
        del self.stack[i:]

    def _context(self, start):
        pieces, size = [], 0
        for piece in self.texts[start:]:
            pieces.append(piece)
            size += len(piece)
            if size > self.context_chars:
                return "".join(pieces)[: self.context_chars] + "..."
        return "".join(pieces)


LINK_SCHEMA = (
    "page_url string, position int, href string, text string, context string, in_zone boolean, in_nav boolean"
)


#: What a parser tells of a link; what it leaves out is empty or false.
_LINK_FIELDS = {"href": "", "text": "", "context": "", "in_zone": False, "in_nav": False}


def link_batches(parser: Callable[[], Callable[[str], Iterable[Mapping]]]) -> Callable[[Iterator], Iterator]:
    """``mapInArrow`` body: one output row per link of the pages ``(page_url, html)``. A task makes its parser once."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        parse = parser()
        kinds = {"page_url": pa.string(), "position": pa.int32(), "href": pa.string(), "text": pa.string(), "context": pa.string(), "in_zone": pa.bool_(), "in_nav": pa.bool_()}
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in kinds}
            for url, html in zip(batch.column("page_url").to_pylist(), batch.column("html").to_pylist()):
                for position, link in enumerate(parse(html)):
                    columns["page_url"].append(url)
                    columns["position"].append(position)
                    for name, missing in _LINK_FIELDS.items():
                        columns[name].append(link.get(name, missing))
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in kinds.items()], names=list(kinds))

    return run
