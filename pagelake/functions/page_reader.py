"""Read one HTML page into text, links, title and first heading.

A small helper around the standard library parser; `operators.fetch.parse_pages`
runs it inside Arrow batches, once per page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements that never hold content.
VOID_ELEMENTS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input "
    "isindex keygen link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose strings are not page text.
HIDDEN_ELEMENTS = frozenset("rp rt script style template".split())
# Elements that keep blank strings as written.
VERBATIM_ELEMENTS = frozenset("pre textarea".split())
SPANNED_ELEMENTS = frozenset("a h1 title".split())
ASCII_BLANKS = " \n\t\f\r"


class PageReader(HTMLParser):
    """Collects the visible strings of a page and the string ranges of some elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.strings: list[str] = []
        self.spans: list[list] = []  # [tag, href, first string, end string]
        self._pending: list[str] = []
        self._stack: list[tuple[str, list | None]] = []
        self._depth: Counter = Counter()
        self._hidden = 0
        self._verbatim = 0

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _end_string(self):
        if not self._pending:
            return
        data = "".join(self._pending)
        self._pending.clear()
        if not self._verbatim and not data.strip(ASCII_BLANKS):
            data = "\n" if "\n" in data else " "
        if not self._hidden:
            self.strings.append(data)

    def handle_starttag(self, tag, attrs):
        self._end_string()
        if tag in VOID_ELEMENTS:
            return
        span = None
        if tag in SPANNED_ELEMENTS:
            span = [tag, dict(attrs).get("href"), len(self.strings), None]
            self.spans.append(span)
        self._stack.append((tag, span))
        self._depth[tag] += 1
        self._hidden += tag in HIDDEN_ELEMENTS
        self._verbatim += tag in VERBATIM_ELEMENTS

    def handle_endtag(self, tag):
        self._end_string()
        while self._depth[tag]:
            if self._leave() == tag:
                break

    def _leave(self):
        tag, span = self._stack.pop()
        if span is not None:
            span[3] = len(self.strings)
        self._depth[tag] -= 1
        self._hidden -= tag in HIDDEN_ELEMENTS
        self._verbatim -= tag in VERBATIM_ELEMENTS
        return tag

    def handle_data(self, data):
        self._pending.append(data)

    def handle_entityref(self, name):
        self._pending.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        number = int(name[1:], 16) if name[0] in "xX" else int(name)
        text = ""
        if number < 256:
            text = bytes([number]).decode("windows-1252", "ignore")
        if not text and number <= 0x10FFFF:
            text = chr(number)
        self._pending.append(text or "�")

    def handle_comment(self, data):
        self._end_string()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_string()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[6:])
            self._end_string()

    def finish(self):
        self.close()
        self._end_string()
        while self._stack:
            self._leave()


# Where a line of page text ends: line ends of any kind, and gaps of two spaces.
LINE_ENDS = re.compile(r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]|  ")


def tidy_lines(text: str) -> str:
    """The pieces between line ends, without outer blanks, one per line; empty ones go."""
    return "\n".join(filter(None, map(str.strip, LINE_ENDS.split(text))))


def _storable(text: str) -> str:
    """Arrow strings hold no lone surrogates."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def span_text(reader: PageReader, span: list) -> str:
    _, _, first, end = span
    return "".join(reader.strings[first:end])


def anchor_text(reader: PageReader, span: list) -> str:
    _, _, first, end = span
    return "".join(map(str.strip, reader.strings[first:end]))


def page_anchors(reader: PageReader, url: str) -> list[dict]:
    """Links with text, in page order. A dict by absolute url keeps the first of each."""
    by_target: dict[str, tuple[str, str]] = {}
    for span in reader.spans:
        if span[0] == "a" and span[1] and (anchor := anchor_text(reader, span)):
            by_target.setdefault(urljoin(url, span[1]), (anchor, span[1]))
    return [
        {"pos": pos, "anchor_text": _storable(anchor), "href": _storable(href), "url": _storable(target)}
        for pos, (target, (anchor, href)) in enumerate(by_target.items())
    ]


def first_text(reader: PageReader, tag: str) -> str | None:
    span = next((span for span in reader.spans if span[0] == tag), None)
    return None if span is None else _storable(span_text(reader, span).strip())


def read_page(url: str, html: str) -> dict:
    """Text, links (first per absolute url, page order), title and heading of a page."""
    reader = PageReader()
    try:
        reader.feed(html)
        reader.finish()
        return {
            "text": _storable(tidy_lines("".join(reader.strings))),
            "links": page_anchors(reader, url),
            "title": first_text(reader, "title"),
            "heading": first_text(reader, "h1"),
        }
    except (AssertionError, ValueError) as problem:
        return {"error": str(problem)}
