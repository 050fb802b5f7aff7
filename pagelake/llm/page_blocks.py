"""Reads one page's markup into text blocks, each with the zone it stands in."""

from __future__ import annotations

import html
import re

CHROME, OPEN, MAIN = 0, 1, 2
# While a page is read: chrome that ends where an article or main element begins, for its names or as a form.
WEAK, FORM = 3, 4

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp svg math object canvas".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CHROME_TAGS = set("nav aside footer form head button select menu dialog search fieldset label datalist audio video map".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MAIN_ROLES = {"main", "article"}
# Parts of class and id names (fixed values) that mark what isn't the article ...
CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside related recommended recommendations"
    " share sharing social comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search form widget"
    " pagination pager toolbar skip copyright disclaimer paywall teaser outbrain taboola".split()
)
# ... of which these are often names of what holds an article ...
WEAK_NAMES = set("banner notice notices notification alert share sharing social search form widget header".split())
# ... and these, as the first part of a name, say that an article element is none ...
NO_ARTICLE = set(
    "ad ads advert advertisement advertising sponsor sponsored promo promoted related recommended sidebar teaser"
    " comment comments reply replies discussion cookie newsletter popup modal overlay".split()
)
# ... unless a whole name says that it is ...
ARTICLE_NAMES = set("post hentry entry article story".split())
# ... unless they only say that a wrapper has such a part ...
WRAPPER_NAMES = set("has no with without wrapper layout page".split())
# ... and whole names that mark the article's body.
MAIN_NAMES = set("article-body articlebody article-content entry-content post-content post-body story-body main-content article-text".split())
# A form around these is a page's wrapper.
PAGE_PARTS = set("header nav footer aside main article".split())
# Elements of running text: inside an article a name such as "notice-period" doesn't settle what they are.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
P_SCOPES = set("article aside blockquote body center dd div dl figure footer form header html li main nav ol section table td th tr ul".split())


def _zone(tag: str, attributes: str, zone: int) -> int:
    """The zone inside an element, given the zone around it."""
    if tag == "main" or tag == "article" and zone in (WEAK, FORM):
        zone = OPEN if zone != MAIN else zone
    if zone == CHROME or tag in CHROME_TAGS and tag != "form":
        return CHROME
    if tag == "form" and zone == MAIN:
        return CHROME
    names: set[str] = set()
    named: list[list[str]] = []
    whole: set[str] = set()
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key == "role" and value.lower() in CHROME_ROLES and not (tag == "form" and value.lower() == "form"):
                return CHROME
            if key == "role" and value.lower() in MAIN_ROLES:
                tag = "main"
            elif key == "itemprop" and value.lower() == "articlebody":
                tag = "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return CHROME
            elif key in ("class", "id") and tag not in ("html", "body", "main"):
                for name in value.split():
                    parts = [p.lower() for p in NAME_PART.findall(name)]
                    if parts and not WRAPPER_NAMES & set(parts):
                        names |= set(parts)
                        named.append(parts)
                    whole.add(name.lower())
    if tag == "article":
        return _article_zone(named, whole)
    if tag == "form":
        return CHROME if names & CHROME_NAMES - {"form"} else zone if zone == WEAK else FORM
    if tag == "header" and zone != MAIN:
        return CHROME
    found = names & CHROME_NAMES
    if "header" in names and zone != MAIN and tag not in HEADINGS:
        found.add("header")
    if found and zone == MAIN and tag in PROSE and not any(CHROME_NAMES.issuperset(parts) for parts in named):
        return OPEN
    if found:
        return max(zone, WEAK) if found <= WEAK_NAMES and zone != MAIN else CHROME
    return MAIN if tag == "main" or whole & MAIN_NAMES and zone not in (WEAK, FORM) else zone


def _article_zone(named: list[list[str]], whole: set[str]) -> int:
    """An article element is one unless its names say that it is a comment, an advert and the like; other boilerplate names leave it open."""
    boilerplate = [parts for parts in named if CHROME_NAMES.issuperset(parts)]
    if any(parts[0] in NO_ARTICLE and (parts in boilerplate or not whole & ARTICLE_NAMES) for parts in named):
        return CHROME
    return OPEN if boilerplate else MAIN


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block in page order; references decoded, white space made one space, no empty blocks.

    An article or main element is the article whatever wraps it by a form or a weak name. Inside it, running text with a
    name of which only a part is listed is OPEN. A page wrapped in one form is read as if the form weren't there.
    """
    page = page or ""
    blocks: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, and zone and heading rule around it
    zone, headings_only, at, size = OPEN, False, 0, len(page)

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                blocks.append((CHROME if zone in (WEAK, FORM) else zone, text))
            buffer.clear()

    def pop_to(k: int) -> None:
        nonlocal zone, headings_only
        _, zone, headings_only = stack[k]
        del stack[k:]

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at and not (headings_only and not any(t in HEADINGS for t, _, _ in stack)):
            buffer.append(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th", "img"):
            buffer.append(" ")
        if end:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                if stack[k][1] != zone or stack[k][2] != headings_only:
                    flush()
                pop_to(k)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else size
            close = page.find(">", at)
            at = close + 1 if stop and close >= 0 else size
            continue
        if tag in BLOCK:  # an open paragraph ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in P_SCOPES:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPES[tag]:
                    break
        if tag == "body":
            for k, entry in enumerate(stack):
                if entry[0] == "head":
                    pop_to(k)
                    break
        if zone == FORM and tag in PAGE_PARTS:  # the form is a wrapper: what follows in it is judged without it
            flush()
            stack = [(name, OPEN if around == FORM else around, rule) for name, around, rule in stack]
            zone = OPEN
        inside = _zone(tag, attributes, zone)
        if inside != zone:
            flush()
        stack.append((tag, zone, headings_only))
        if tag == "header" and zone == MAIN:
            headings_only = True
        zone = inside
    flush()
    return blocks
