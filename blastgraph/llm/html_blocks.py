"""Leaf sequences of HTML pages: every run of text with its tag path, in page order.

A tolerant scanner, not a tree builder: it keeps the stack of open elements, closes what HTML
lets stay open (p, li, cells), ignores end tags that close nothing, and never fails. Inline
elements, ``br`` among them, continue a block; any other tag ends it. What scripts, styles,
comments, the head and form controls hold is no text of the page. Character references are
decoded once, in each run of text between two tags; white space inside a block becomes one space.

The head ends where HTML ends it: at its end tag, at text, or at any element that can't lie in it. A form
control is a hole in its block: it goes on to its end tag, or, where the next tag of its kind is none, to the
next border of a block. A quote opens an attribute value only right after "=", and only if its closing quote
is followed by white space, "/" or ">", or comes before any "<"; any other quote is an ordinary character, so
the tag ends at the next ">" and no text is lost to a stray or unclosed one. Time is linear in a page's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr math mfrac mi mn mo mroot mrow ms msqrt msub msup mtext semantics".split()
)
RAW = frozenset("script style template noscript textarea title iframe svg xmp noembed noframes".split())
#: Of these the ones that an end tag must close; the others count as absent where it is missing.
TO_THE_END = frozenset("script style textarea title xmp".split())
CONTROLS = frozenset("select option button datalist".split())
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"},
}
#: Block elements end an open paragraph; list items and cells close only inside their own list or table.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
KEEPS_P = INLINE | CONTROLS
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"""(?:"([^"<]*+(?=")|[^"]*+(?="(?:[\s/>]|\Z)))"|'([^'<]*+(?=')|[^']*+(?='(?:[\s/>]|\Z)))'|([^\s>]++))"""
ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+{_VALUE})?+")
_PLAIN = re.sub(r"(?<!\\)\((?!\?)", "(?:", ATTRIBUTE.pattern)
TAG = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PLAIN})*+)(?:>|\Z))", re.S
)
#: The next tag of a control's kind, an end tag or not.
_CONTROL = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in sorted(CONTROLS)}
NAMES = re.compile(r"[a-z]+|\d+")
#: Places of the names on a path, and how many of its innermost names are kept in order.
PLACES, INNERMOST = 64, 3


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _names(tag: str, source: str) -> tuple[str, ...]:
    """What a tag adds to the path: its name, and the words of its class, id and role."""
    if not source or "=" not in source:
        return (tag,)
    found = attributes(source)
    words = NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(found.get(k, "") for k in ("class", "id", "role"))).lower())
    hidden = ("hidden",) if re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("aria-hidden") == "true" else ()
    return (tag, *(f".{w}" for w in words), *hidden)


@lru_cache(50_000)
def _bit(name: str) -> int:
    return 1 << zlib.crc32(name.encode()) % PLACES


class Element:
    """An open element, linked to the one around it. ``bits``: the hashed places of all names from
    the root to here; ``last``: the innermost names that aren't class, id or role words."""

    __slots__ = ("around", "tag", "names", "bits", "last")

    def __init__(self, around: Element | None, tag: str, names: tuple[str, ...]):
        self.around, self.tag, self.names = around, tag, names
        self.bits = around.bits if around else 0
        for name in names:
            self.bits |= _bit(name)
        self.last = ((around.last if around else ()) + tuple(n for n in names if n[0] != "."))[-INNERMOST:]


class Block:
    """text; at: the innermost open element, None outside all; share of characters inside links."""

    __slots__ = ("text", "at", "linked")

    def __init__(self, text: str, at: Element | None, linked: float):
        self.text, self.at, self.linked = text, at, linked

    @property
    def path(self) -> Iterator[str]:
        """The names of the open elements with their class, id and role words, innermost element first."""
        at = self.at
        while at is not None:
            yield from at.names
            at = at.around


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order; empty ones are left out."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    never_closed: set[str] = set()
    parts: list[str] = []
    linked = 0
    hole = False

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if opened["head"] and text.strip():
            close_head()
        if text and not hole and not opened["head"]:
            parts.append(text)
            linked += len(text) if opened["a"] else 0

    def pop(to: int) -> None:
        if any(e.tag not in INLINE for e in stack[to:]):
            end()
        for e in stack[to:]:
            opened[e.tag] -= 1
        del stack[to:]

    def close_head() -> None:
        pop(next(i for i, e in enumerate(stack) if e.tag == "head"))

    def control_end(tag: str, at: int) -> int | None:
        """Behind the end tag of a control that began before ``at``; None where none is its own."""
        found = _CONTROL[tag].search(html, at)
        if found is None or not found[1]:
            return None
        stop = html.find(">", found.end())
        return size if stop < 0 else stop + 1

    def close(names: set[str], fence: set[str] = frozenset()) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i].tag
            if tag in names:
                pop(i)
                return
            if tag in fence or not fence and tag not in INLINE and tag != "p":
                return

    def raw_end(tag: str, at: int):
        if tag in never_closed:
            return None
        stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
        if stop is None:
            never_closed.add(tag)
        return stop

    at = 0
    size = len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            said(unescape(html[at:]))
            break
        if m.start() > at:
            said(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            hole = False
        if m[1]:
            if tag in CONTROLS:
                continue
            if opened[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            elif tag not in INLINE:
                end()
            continue
        if opened["head"] and tag not in IN_HEAD:
            close_head()
        if tag in CONTROLS:
            stop = control_end(tag, at)
            hole, at = (True, at) if stop is None else (hole, stop)
            continue
        if tag not in KEEPS_P:
            close({"p"})
        if tag in CLOSES:
            close(CLOSES[tag] - {"p"}, FENCES.get(tag, set()))
        if tag in RAW:
            stop = raw_end(tag, at)
            if tag != "svg":
                end()
            if tag == "xmp":
                said(html[at : stop.start() if stop else size])
                end()
            at = stop.end() if stop else size if tag in TO_THE_END else at
            continue
        if tag in ("br", "img", "wbr"):
            said(" ")
            continue
        if tag not in INLINE:
            end()
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "a"):
            continue
        stack.append(Element(stack[-1] if stack else None, tag, _names(tag, m[3])))
        opened[tag] += 1
    end()
    return out
