"""Leaf blocks of a page: runs of text with the tags around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])(?!(?<=style|title)[^>]*/>)[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
#: Tags whose text is none of the page's if they are closed; others are tags like any, which end with the one around them.
_HIDDEN = frozenset("noscript template svg select iframe".split())
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Tags that a block does not end at.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span "
                   "strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an open tag of the key's kind ends by itself, when one of these begins.
_ENDS = {"p": frozenset("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 "
                        "blockquote pre hr figure".split()),
         "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
         "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


@dataclass
class Block:
    """Text with character references decoded and white space single, and the names of the tags and classes around it."""

    text: str
    path: tuple[str, ...]
    links: int  # characters of it inside links


def _hidden_ends(tokens: list[re.Match]) -> dict[int, int]:
    """For each hidden tag that is closed before the tag around it is, the token after its closing tag."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    places: dict[str, int] = {}  # how many of a name are open
    for at, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if not tag or tag in VOID:
            continue
        if m[2]:
            while places.get(tag):
                name, start = opened.pop()
                places[name] -= 1
                if name == tag:
                    if name in _HIDDEN:
                        ends[start] = at + 1
                    break
        elif tag != "svg" or not m[4].endswith("/"):
            opened.append((tag, at))
            places[tag] = places.get(tag, 0) + 1
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """All blocks with text in page order; markup, scripts, styles, comments and the head's title are none."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            blocks.append(Block(text, tuple(n for _, names in stack for n in names), min(linked, len(text))))
        parts.clear()
        linked = 0

    tokens = list(_TOKEN.finditer(page))
    ends = _hidden_ends(tokens)
    past = 0
    for at, m in enumerate(tokens):
        if at < past:
            continue
        token, tag = m[0], (m[3] or "").lower()
        if at in ends:
            past = ends[at]
            continue
        if token[0] != "<" or token == "<":
            parts.append(token)
            linked += len(token) if in_link else 0
        elif not tag:
            continue
        elif tag in INLINE:
            in_link = tag == "a" and not m[2] or in_link and tag != "a"
            if tag == "br":
                parts.append(" ")
        elif m[2]:
            flush()
            in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            flush()
            in_link = False
            while stack and tag in _ENDS.get(stack[-1][0], ()):
                stack.pop()
            if tag not in VOID and not m[4].endswith("/"):
                named = " ".join(a or b or c for a, b, c in _NAMED.findall(m[4])).lower()
                stack.append((tag, (tag, *("." + n for n in re.split(r"[\s_-]+", named) if n))))
    flush()
    return blocks
