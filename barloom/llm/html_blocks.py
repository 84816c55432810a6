"""Cuts a page into its leaf blocks of text, each with the tag path that it stands under.

A block is what stands between two boundaries of block elements: inline tags don't cut it, and a line break is white
space. Scripts, styles, titles, comments and markup are no text. Broken markup is read as browsers read it: an open
paragraph, list item or cell ends where the next begins, an end tag without a start means nothing, and what a page's end
cuts short is dropped if it is a tag and kept if it is text. All steps take time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

# Names of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html ins label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: What a start tag ends, and what shields it from doing so.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KEEP_P_OPEN = frozenset("button ins label noscript option optgroup select svg template".split())

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|(?P<cut>\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[^\W\dA-Za-z_]+")


class Block(NamedTuple):
    text: str
    #: Distinct tokens of the path: tags, and words of classes, ids and roles.
    path: tuple[str, ...]
    #: Share of its characters that stand in links.
    linked: float


def attribute_tokens(rest: str) -> list[str]:
    found = []
    if "=" in rest or "hidden" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id", "role"):
                found += ["." + w.lower() for w in _WORDS.findall(value)]
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.append("?hidden")
    return found


def leaf_blocks(page: str) -> list[Block]:
    """All blocks of a page that hold more than white space, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ("root",))]
    depths: dict[str, list[int]] = defaultdict(list)  # where elements of a name stand in the stack
    parts: list[str] = []
    linked, link_depth = 0, 0  # characters in links of the block at hand; the depth at which a link opened, 0 if none

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                size = sum(map(len, parts))
                out.append(Block(text, stack[-1][1], linked / size))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()
        if link_depth > len(stack):
            link_depth = 0

    def close(names: set[str], shields: set[str] | frozenset[str]) -> None:
        """End the nearest open element of these names, unless a shield or the root comes first."""
        nearest = max((depths[n][-1] for n in names if depths[n]), default=0)
        if nearest > max((depths[n][-1] for n in shields if depths[n]), default=0):
            pop_to(nearest)

    def text_of(start: int, end: int) -> None:
        nonlocal linked
        if start < end:
            piece = page[start:end]
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if link_depth:
                linked += len(piece)

    at = 0
    for token in iter(lambda: _TOKEN.search(page, at), None):
        text_of(at, token.start())
        at = token.end()
        name = token["name"]
        if name is None or token["cut"] is not None:
            continue
        name = name.lower()
        if token["end"]:
            if name in BLOCKS:
                flush()
                close({name}, frozenset())
            elif name == "a":
                link_depth = 0
            continue
        if name in RAW:
            ended = _RAW_END[name].search(page, at)
            at = ended.start() if ended else len(page)
        elif name == "br":
            parts.append(" ")
        elif name == "hr":
            flush()
            if stack[-1][0] == "p":
                pop_to(len(stack) - 1)
        elif name == "a":
            link_depth = len(stack)
        elif name in BLOCKS and name not in EMPTY:
            flush()
            if name not in KEEP_P_OPEN and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if name in ENDS:
                close(*ENDS[name])
            path = stack[-1][1]
            new = [t for t in dict.fromkeys([name, *attribute_tokens(token["rest"])]) if t not in path]
            depths[name].append(len(stack))
            stack.append((name, path + tuple(new) if new else path))
    text_of(at, len(page))
    flush()
    return out
