"""Blocks of a web page: its texts in order, each marked as main text, as surroundings of some kind, or as neither."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from typing import NamedTuple

#: Elements whose content is no text; that hold surroundings; that end a block; hints in class, id and role.
RAW = frozenset(("script", "style", "noscript", "template", "title", "textarea", "iframe", "object", "svg", "math", "select", "button", "canvas", "audio", "video", "head"))
AROUND = frozenset(("nav", "footer", "header", "aside", "form", "dialog", "menu", "fieldset"))
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|comments?|commentlist|repl(?:y|ies)|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|search|complementary|contentinfo|skip(?:link)?)(?:$|[\s_-])",
    re.I,
)
_HOLDERS = frozenset(("div", "section", "ul", "ol", "dl", "table", "article", "details", "p", "span", "td", "figure"))
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
MAIN, SURROUNDING, OPEN = 0, 1, 2
#: The kind of what stands outside the article of a page that has one.
OUTSIDE = "outside"


class Block(NamedTuple):
    """kind: of surroundings, the element of AROUND or the word of HINT that makes them so; box: the same for all blocks of one such element."""

    mark: int
    text: str
    kind: str
    box: int


@dataclass
class Tag:
    at: int
    end: int
    name: str
    close: bool
    attrs: str
    match: int = -1


def _tags(page: str) -> list[Tag]:
    out: list[Tag] = []
    open_: dict[str, list[int]] = {}
    low, at = None, 0
    while at < len(page):
        at = page.find("<", at)
        if at < 0:
            break
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if m is None:
            if page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("/", "!", "?"):  # cut off inside a tag
                out.append(Tag(at, len(page), "", False, ""))
                break
            at += 1
            continue
        name = m[2] if m.re is _LOOSE or m[2] else None
        if not name:
            out.append(Tag(at, m.end(), "", False, ""))
            at = m.end()
            continue
        name, end = name.lower(), m.end()
        tag = Tag(at, end, name, bool(m[1]), m[3])
        if tag.close:
            if open_.get(name):
                k = open_[name].pop()
                out[k].match = len(out)
        elif name in RAW and name != "head" and not m[3].endswith("/"):
            low = low or page.lower()
            stop = low.find(f"</{name}", end) if len(low) == len(page) else page.find(f"</{name}", end)
            if stop >= 0:
                close = page.find(">", stop)
                end = close + 1 if close >= 0 else len(page)
            elif name in ("script", "style"):
                end = len(page)
            tag.end = end
        elif not m[3].endswith("/"):
            open_.setdefault(name, []).append(len(out))
        out.append(tag)
        at = end
    return out


def _hints(attrs: str) -> tuple[str, str]:
    """(class, id and role, the rest that counts) of a tag's attributes."""
    if "=" not in attrs:
        return "", ""
    found = [(k.lower(), v.strip("\"'")) for k, v in _ATTR.findall(attrs)]
    return " ".join(v for k, v in found if k in ("class", "id", "role")), " ".join(f"{k}={v}" for k, v in found if k in ("role", "itemprop"))


def blocks(page: str | None) -> list[Block]:
    """The blocks that aren't empty, in page order.

    White space inside a block is one space, character references are decoded, inline tags leave no trace and
    a line break is white space. The content of an article (else of main) outside surroundings is MAIN;
    surroundings are elements of AROUND and elements whose class, id or role says so, a header inside the main
    text excepted. Elements that are not closed don't count as surroundings, but for a footer. The rest is SURROUNDING, of the kind
    OUTSIDE and each in a box of its own, where the page has an article (or main), else OPEN.
    """
    if not page:
        return []
    tags = _tags(page)
    mains = [(k, t.match) for k, t in enumerate(tags) if not t.close and t.match > 0 and t.name == "article"]
    if not mains:
        mains = [(k, t.match if t.match > 0 else len(tags)) for k, t in enumerate(tags) if not t.close and (t.name == "main" or (t.attrs and ("main" in t.attrs or "articleBody" in t.attrs) and _hints(t.attrs)[1] in ("role=main", "itemprop=articleBody")))]
    out: list[Block] = []
    buffer: list[str] = []
    around_end = main_end = -1
    kind, box, at = "", 0, 0

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text and around_end >= 0:
                out.append(Block(SURROUNDING, text, kind, box))
            elif text and main_end >= 0:
                out.append(Block(MAIN, text, "", -1))
            elif text:
                out.append(Block(SURROUNDING, text, OUTSIDE, -2 - len(out)) if mains else Block(OPEN, text, "", -1))

    starts = dict(mains)
    for k, tag in enumerate(tags):
        if tag.at > at:
            buffer.append(page[at : tag.at])
        at = tag.end
        if tag.name in RAW or tag.name == "br":
            buffer.append(" ")
        if tag.name not in BLOCK and tag.name not in _HOLDERS:
            continue
        around = False
        if not tag.close and around_end < 0:
            if tag.name in AROUND:
                around, name = not (tag.name == "header" and main_end >= 0), tag.name
            elif tag.name in _HOLDERS and tag.attrs:
                hint = _hints(tag.attrs)[0]
                found = HINT.search(hint) if hint else None
                around = found is not None
                name = found[0].strip(" \t\n\r\f_-").lower() if found else ""
            if around and main_end < 0 and tag.match > 0 and any(k < a < tag.match and (b > 0) for a, b in mains) and tag.name != "aside" and not re.search(r"comment|repl|related|side", tag.attrs, re.I):
                around = False  # it holds the main text
        if tag.name in BLOCK or around:
            flush()
        if around and (tag.match > 0 or tag.name == "footer"):
            around_end = tag.match if tag.match > 0 else len(tags)
            kind, box = name, k
        elif k in starts and main_end < 0 and around_end < 0:
            main_end = starts[k]
        if k == around_end:
            flush()
            around_end = -1
        if k == main_end:
            flush()
            main_end = -1
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out
