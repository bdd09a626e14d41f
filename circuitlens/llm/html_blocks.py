"""Flat text blocks of a web page, with what a classifier of main text looks at."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks whose text belongs together; the others structure it.
CONTAINERS = frozenset("article aside body center dialog div footer form header main nav section td th".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose inside is no text of the page; of the first group it ends with the page where the end tag is missing.
RAW, SKIPPED = frozenset(("script", "style", "textarea", "title", "xmp")), frozenset("audio button canvas iframe math noembed noframes noscript object select svg template video".split())
#: Blocks that end an open block of the same row.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
GOOD_TAGS, BAD_TAGS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"))
#: Words in the class, id or role of an element that tell what it is for.
GOOD_WORDS = frozenset("article content entry main post story text".split())
BAD_WORDS = frozenset(
    "ad ads alert breadcrumb breadcrumbs byline complementary consent contentinfo copyright disclaimer discussion disqus foot gdpr hidden login masthead menu meta modal notice notices "
    "overlay pager pagination rail recommended related replies reply respond responses search share sharing side signup social tags thread toolbar widget widgets".split()
)
#: Beginnings of more such words.
BAD_STARTS = ("advert", "banner", "comment", "cookie", "footer", "header", "nav", "newsletter", "popup", "promo", "sidebar", "sponsor", "subscri")

_NAME = r"[a-zA-Z][^\s/>]*+"
_TAG = re.compile(rf"<(/?)({_NAME})((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_START = re.compile(r"</?[a-zA-Z]")
_PURPOSE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """Its text; words, and those within links; 1, -1 or 0 as its surroundings are named like main text, like something else or not at all; whether it
    is a heading; unlinked words of its container over those of the page's largest; where it starts in the page."""

    text: str
    words: int
    linked: int
    hint: int
    heading: bool
    share: float
    start: int


@lru_cache(10_000)
def _hint(tag: str, attributes: str) -> int:
    """What an element says of its inside: 1 main text, -1 something else, 0 nothing."""
    if tag in ("html", "body"):
        return 0
    words = {w.lower() for m in _PURPOSE.finditer(attributes) for w in _WORDS.findall(m[1])}
    if tag in BAD_TAGS or words & BAD_WORDS or any(w.startswith(BAD_STARTS) for w in words) or attributes and _HIDDEN.search(attributes):
        return -1
    return int(tag in GOOD_TAGS or bool(words & GOOD_WORDS))


class _Open(NamedTuple):
    tag: str
    hint: int
    within: int  # the hint around the nearest element that has one
    header: bool  # whether that element is a header
    container: int


def _tags(page: str):
    """(start, end, closing, name, attributes) of the tags in turn; comments and what scripts hold come as tags without a name."""
    at, plain, absent = 0, False, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = start + 5 if page.startswith("<!-->", start) else page.find("-->", start + 4) + 3
            at = end if end > 2 else len(page)
            yield start, at, True, "", ""
        elif page.startswith(("<!", "<?"), start) or page.startswith("</", start) and not _START.match(page, start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, True, "", ""
        elif not _START.match(page, start):
            end = page.find("<", start + 1)
            at = end if end >= 0 else len(page)
            yield start, start, True, "", ""  # a lone sign: text up to the next one
        else:
            found = None if plain else _TAG.match(page, start)
            if found:
                closing, name, attributes, end = found[1] == "/", found[2].lower(), found[3], found.end()
            else:  # no sign outside of quotes ends it: from here on quotes don't count
                plain, end = True, page.find(">", start) + 1
                if not end:
                    yield start, len(page), True, "", ""
                    return
                closing = page[start + 1] == "/"
                name, _, attributes = page[start + 1 + closing : end - 1].partition(" ")
                name = name.lower()
            at = end
            if not closing and (name in RAW or name in SKIPPED and not attributes.endswith("/")):
                close = None if name in absent else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, end)
                if close:
                    at = close.start()
                elif name in RAW:
                    at = len(page)
                else:
                    absent.add(name)
                yield start, at, True, "", ""
            else:
                yield start, end, closing, name, attributes


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in its order: character references decoded, white space as one blank, empty blocks left out.

    Unclosed and misplaced tags are taken as browsers take them, in time
    linear in the page. Scripts, styles, comments, form controls and other
    elements without text are passed over.
    """
    found: list[list] = []
    stack, counts = [_Open("body", 0, 0, False, 0)], {}
    containers, link = 1, 0  # link: depth of the stack at the open link
    parts, linked, first, last = [], 0, -1, 0
    top = stack[0]

    def flush(tag: str) -> None:
        nonlocal parts, linked, first
        words = "".join(parts).split()
        if words:
            heading = tag in HEADINGS
            hint = 1 if heading and top.hint < 0 and top.header and top.within > 0 else top.hint
            found.append([" ".join(words), len(words), min(linked, len(words)), hint, heading, top.container, first])
        parts, linked, first = [], 0, -1

    def close() -> None:
        nonlocal top, link
        counts[stack.pop().tag] -= 1
        top = stack[-1]
        link = 0 if link > len(stack) else link

    def take(start: int, end: int) -> None:
        nonlocal linked, first
        text = unescape(page[start:end])
        parts.append(text)
        first = first if first >= 0 or text.isspace() else start
        linked += len(text.split()) if link else 0

    for start, end, closing, name, attributes in _tags(page):
        if start > last:
            take(last, start)
        last = end
        if name == "a":
            link = 0 if closing or "href" not in attributes.lower() else len(stack)
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK_TAGS:
            if closing and not counts.get(name) and name != "p":
                continue
            flush(top.tag)
            if closing:
                if counts.get(name):
                    while stack[-1].tag != name:
                        close()
                    close()
                continue
            if top.tag == "p":
                close()
            while top.tag in SIBLINGS.get(name, ()):
                close()
            if name in ("hr", "html", "body"):
                continue
            hint = _hint(name, attributes)
            own = containers if name in CONTAINERS else top.container
            containers += name in CONTAINERS
            new = _Open(name, hint, top.hint, name == "header", own) if hint else _Open(name, top.hint, top.within, top.header, own)
            stack.append(new)
            top = new
            counts[name] = counts.get(name, 0) + 1
    if last < len(page):
        take(last, len(page))
    flush(top.tag)

    weight: dict[int, int] = {}
    for block in found:
        weight[block[5]] = weight.get(block[5], 0) + block[1] - block[2]
    largest = max([1, *weight.values()])
    return [Block(*b[:5], weight[b[5]] / largest, b[6]) for b in found]
