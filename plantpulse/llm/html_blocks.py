"""HTML as a sequence of leaf blocks with their ancestors.

A leaf block is the text between two block boundaries.  The scanner is a
tolerant one: unclosed and stray tags, cut-off pages, comments and quoted
attributes are handled as browsers do, as far as text and ancestors go.

Work is linear in the page: open elements are nodes that share their
ancestors, the open elements of each tag are indexed, and a quote or end mark
that was looked for in vain is not looked for again.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

#: Elements that never hold shown text (fixed values).
SILENT = frozenset("script style title noscript template svg math iframe object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: An element of the first kind ends an open one of the second kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol menu dl table select".split())

_NAME = re.compile(r"[^\s/>]*")
_UP_TO = re.compile(r"[^>=]*")
_SPACE = re.compile(r"\s*")
_BARE = re.compile(r"[^\s>]*")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-zA-Z]+")
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
_SILENT_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}


class Element:
    """An open element; ``named`` is the innermost one with class, id or role.
    ``features`` and ``known`` are room for what is derived from its path."""

    __slots__ = ("depth", "features", "known", "named", "parent", "tag", "words")

    def __init__(self, parent: "Element | None", tag: str, words: tuple):
        self.parent, self.tag, self.words = parent, tag, words
        self.depth = parent.depth + 1 if parent else 1
        self.named = self if words else parent.named if parent else None
        self.features = self.known = None


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    element: Element | None  # the innermost open element

    @property
    def path(self) -> tuple:
        """(tag, class and id words) of each open element, from the outermost."""
        out, e = [], self.element
        while e:
            out.append((e.tag, e.words))
            e = e.parent
        return tuple(reversed(out))


class _Open:
    """The open elements as a stack, with the places of each tag's."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def push(self, tag: str, words: tuple) -> None:
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(Element(self.stack[-1] if self.stack else None, tag, words))

    def cut(self, at: int) -> None:
        """Close the elements from place ``at`` on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def begin(self, tag: str) -> None:
        """What a block of that tag ends when it begins."""
        for closing in ENDS.get(tag, ()):
            at = self.last(closing)
            if at > self.last(*_LISTS):
                self.cut(at)
        if self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at >= 0 and (tag in BLOCK or not self.blocks or at > self.blocks[-1]):
            self.cut(at)


class _Marks:
    """Searches for end marks that remember which are no longer there."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def after(self, mark: str, at: int) -> int:
        """The place after the next such mark, or -1."""
        if mark in self.gone:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.gone.add(mark)
            return -1
        return found + len(mark)

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` of a tag whose attributes start at ``at``, or -1.

        A quote counts after an equals sign; one that is never closed doesn't.
        """
        html, n = self.html, len(self.html)
        while True:
            at = _UP_TO.match(html, at).end()
            if at >= n:
                return -1
            if html[at] == ">":
                return at + 1
            at = _SPACE.match(html, at + 1).end()
            if at < n and html[at] in "\"'":
                closed = self.after(html[at], at + 1)
                at = closed if closed >= 0 else at + 1
            else:
                at = _BARE.match(html, at).end()


def blocks(html: str) -> list[Block]:
    """The shown leaf blocks of a page, in order; empty ones are left out."""
    out: list[Block] = []
    open_, marks = _Open(), _Marks(html)
    text: list[str] = []
    linked = 0
    at, n = 0, len(html)

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, linked, open_.stack[-1] if open_.stack else None))
            text.clear()
        linked = 0

    def say(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        text.append(piece)
        if open_.places["a"]:
            linked += len(piece.strip())

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        follows = html[lt + 1 : lt + 3]
        if follows[:1].isalpha() and follows[:1].isascii():
            named = _NAME.match(html, lt + 1)
            end = marks.tag_end(named.end())
            if end < 0:  # a cut-off tag
                break
            at, tag, attributes = end, named[0].lower(), html[named.end() : end - 1]
            if tag in SILENT:
                if not attributes.endswith("/"):
                    # the head ends where the body begins
                    found = (_HEAD_END if tag == "head" else _SILENT_END[tag]).search(html, at)
                    at = found.end() if found else n
            elif tag == "br":
                text.append(" ")
            else:
                if tag in BLOCK:
                    flush()
                    open_.begin(tag)
                if tag not in VOID:
                    words: tuple = ()
                    if "=" in attributes:
                        found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
                        words = tuple(w.lower() for w in _PART.findall(found))
                    open_.push(tag, words)
        elif follows[:1] == "/" and follows[1:].isalpha() and follows[1:].isascii():
            named = _NAME.match(html, lt + 2)
            end = marks.after(">", named.end())
            at, tag = end if end >= 0 else n, named[0].lower()
            if tag in BLOCK:
                flush()
            open_.end(tag)
        elif html.startswith("<!--", lt):
            end = marks.after("-->", lt + 2)
            at = end if end >= 0 else n
        elif follows[:1] in ("!", "?", "/") and follows:
            end = marks.after(">", lt)
            at = end if end >= 0 else n
        else:
            say("<")
            at = lt + 1
    flush()
    return out
