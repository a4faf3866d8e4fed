"""HTML to leaf blocks: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass

# Elements of HTML by their part in layout.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source input br noscript object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands between these is no text of the page, up to their end, whatever tags it holds.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Between these all tags are inline until one of layout ends them; a form's choices are no text of the page.
FOREIGN = frozenset(("svg", "math", "select"))
#: An opening tag of the key ends open elements of the values, up to the nearest of _SCOPE.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_SCOPE = frozenset("article aside blockquote body div dl fieldset figure footer form header html main menu nav ol section table ul".split())

#: Attributes up to the tag's end; an unclosed quote runs to the end of the page.
_ATTRS = r"(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?![a-zA-Z0-9:-]){_ATTRS}(?:/>|\Z|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|</(?P<end>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)"
    rf"|<(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Element:
    """An open element: tag, name words, the element around it, and those of its
    features (`tag:`, `name:`) that no element around it has."""

    __slots__ = ("tag", "names", "up", "fresh")

    def __init__(self, tag: str, names: tuple[str, ...], up: Element | None, fresh: tuple[str, ...]):
        self.tag, self.names, self.up, self.fresh = tag, names, up, fresh


@dataclass(slots=True)
class Block:
    """text: white space as one space, trimmed; at: the element around it, if any; linked: characters in links."""

    text: str
    at: Element | None
    linked: int


class _Open:
    """The open elements, with the places of each tag and the features that they have."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.held: dict[str, int] = {}

    def _features(self, tag: str, names: tuple[str, ...]) -> list[str]:
        return ["tag:" + tag, *["name:" + n for n in names]]

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        own = self._features(tag, names)
        fresh = tuple(f for f in own if not self.held.get(f))
        for f in own:
            self.held[f] = self.held.get(f, 0) + 1
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, names, self.stack[-1] if self.stack else None, fresh))

    def cut(self, at: int) -> None:
        """Close all from place `at` on."""
        while len(self.stack) > at:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if self.scopes and self.scopes[-1] == len(self.stack):
                self.scopes.pop()
            for f in self._features(e.tag, e.names):
                self.held[f] -= 1

    def close(self, tag: str) -> None:
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def close_all(self, tags) -> None:
        """Close the outermost of `tags` within the nearest _SCOPE, and all in it."""
        floor, found = self.scopes[-1] if self.scopes else -1, len(self.stack)
        for t in tags:
            places = self.places.get(t)
            if places and places[-1] > floor:
                found = min(found, places[bisect_right(places, floor)])
        self.cut(found)


def _names(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role, split at case and punctuation."""
    if not attrs or attrs.isspace():
        return ()
    words: list[str] = []
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id", "role"):
            words += [w.lower() for w in _NAME.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
    return tuple(dict.fromkeys(words))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, without raw and dropped elements.

    An element is stored once, whatever it holds, so memory and time grow with
    the page's length, not with its depth.
    """
    out: list[Block] = []
    around = _Open()
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    foreign: list[str] = []

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not around.places.get("template"):  # a template is not shown
                linked = len(SPACE.sub(" ", "".join(links)).strip()) if links else 0
                out.append(Block(text, around.stack[-1] if around.stack else None, linked))
            parts, links = [], []

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if "select" in foreign:
                continue
            parts.append(m["text"])
            if in_link:
                links.append(m["text"])
            continue
        tag = m["tag"]
        if tag is not None:
            tag = tag.lower()
            closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else None)
            if foreign and (closes or tag == "body"):
                foreign.clear()
            if tag in INLINE or tag in FOREIGN or foreign:
                if tag == "br":
                    parts.append("\n")
                elif tag == "a":
                    in_link += 1
                elif tag in FOREIGN and tag not in foreign and not m["attrs"].endswith("/"):
                    foreign.append(tag)
                continue
            flush()
            if closes:
                around.close_all(closes)
            if tag not in VOID and not m["attrs"].endswith("/"):
                around.push(tag, _names(m["attrs"]))
        elif m["end"] is not None:
            tag = m["end"].lower()
            if tag in INLINE or tag in FOREIGN or foreign and not around.places.get(tag):
                if tag == "a" and in_link:
                    in_link -= 1
                elif tag in foreign:
                    foreign.remove(tag)
                continue
            flush()
            in_link = 0
            foreign.clear()
            around.close(tag)
    flush()
    return out
