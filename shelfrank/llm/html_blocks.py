"""Leaf blocks of an HTML page: tag path, text, links.

A block is the text between two block-level tags; inline tags do not end it and
``br`` is white space. Scripts, styles and the title are markup, not blocks; other text ends the head,
as in browsers. Drawings, select lists, ``noscript`` and ``template`` go if they are closed. Tags that the
page leaves open are closed as browsers do for paragraphs, list items and table parts.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br img "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub "
                   "msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics maction".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # up to the end tag or the end of the page
HIDDEN = frozenset("noscript template svg select annotation annotation-xml".split())  # up to the end tag, if there is one
FOREIGN = frozenset("svg annotation annotation-xml".split())  # "/>" closes them
# an opening tag that ends an open one of these
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol pre section table ul".split())
# quoted values may hold ">"; atomic and possessive, so that a broken page costs no backtracking
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
                  r"|<[!?][^>]*>|<(?=[/!?a-zA-Z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Path:
    """An open tag: its names ("tag", "class token", ...) under those of the tag around it. Blocks share these
    nodes, so that paths take room in proportion to the tags."""

    __slots__ = ("names", "parent")

    def __init__(self, parent: Path | None, names: tuple):
        self.parent, self.names = parent, names


class Block(NamedTuple):
    node: Path | None  # None: directly in the body
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> tuple:
        """All names from the body down."""
        parts, at = [], self.node
        while at is not None:
            parts.append(at.names)
            at = at.parent
        return tuple(n for names in reversed(parts) for n in names)


def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


# tags of HTML that end a drawing left open
_HTML_TAG = re.compile(r"<(?:/?(?:body|article|main|section)|p|div|h[1-6]|ul|ol|table|blockquote|pre)(?=[\s/>])|</svg(?=[\s/>])[^>]*>", re.I)


def _hidden_end(page: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Where the page goes on after a hidden tag that opened before ``at``: at once if nothing closes it."""
    if tag in unclosed:
        return at
    end = (_HTML_TAG if tag == "svg" else _end_tag(tag)).search(page, at)
    if not end:
        unclosed.add(tag)
        return at
    return end.end() if end[0].startswith("</") and end[0][2:2 + len(tag)].lower() == tag else end.start()


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order; null and empty pages have none."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    parts: list[str] = []
    linked = link_depth = 0
    open_tags: dict[str, int] = {}
    unclosed: set[str] = set()  # hidden tags without an end tag in the rest of the page
    path: Path | None = None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    at, find = 0, _TAG.search
    while True:
        m = find(page, at)
        chunk = page[at:m.start()] if m else page[at:]
        if chunk:
            parts.append(chunk)
            if link_depth:
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in FOREIGN and m[3].endswith("/"):
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link_depth = 0 if closing else 1
            continue
        if tag in FOREIGN - {"svg"}:  # inside a formula
            at = _hidden_end(page, tag, at, unclosed) if not closing else at
            continue
        flush()
        link_depth = 0
        if not closing and tag in RAW:
            end = _end_tag(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in HIDDEN:
            at = _hidden_end(page, tag, at, unclosed) if not closing else at
            continue
        if tag in ("html", "head", "body") or tag in VOID:
            continue
        if closing:
            while open_tags.get(tag):  # a tag that is not open closes nothing
                last = stack.pop()[0]
                open_tags[last] -= 1
                if last == tag:
                    break
        else:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in NOT_IN_P else set())
            while stack and stack[-1][0] in ends:
                open_tags[stack.pop()[0]] -= 1
            names = [tag]
            for a in _ATTRIBUTE.finditer(m[3]):
                names += [f"{a[1].lower()}={w}" for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())]
            stack.append((tag, Path(stack[-1][1] if stack else None, tuple(names))))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        path = stack[-1][1] if stack else None
    flush()
    return out
