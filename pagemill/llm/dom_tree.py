"""A small tree of the block elements of a page, with their runs of text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: Elements whose content is text up to their own end tag.
TEXT_ONLY = frozenset(("title", "textarea", "script", "style", "xmp", "iframe", "noembed", "noframes"))
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends an open element of the named kinds, up to the element where such kinds belong.
ENDS_SAME = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAMING = ("class", "id", "role", "itemprop")


@dataclass
class Page:
    """Nodes in page order, so a parent stands before its children. ``runs`` are (node, text) in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: tuple[str, ...], label: str | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tag) - 1


def _attributes(text: str) -> tuple[tuple[str, ...], str | None]:
    """Words of the naming attributes in lower case, and the value of data-label, which labelled pages carry."""
    names: list[str] = []
    label = None
    for m in _ATTRIBUTE.finditer(text):
        key = m[1].lower()
        if key in _NAMING:
            names += (p.lower() for p in _NAME_PARTS.findall(m[2] or m[3] or m[4] or ""))
        elif key == "data-label":
            label = m[2] or m[3] or m[4]
    return tuple(names), label


def parse(html: str | None) -> Page:
    """The tree of a page. White space inside a run is one space, its ends are trimmed, empty runs are left out."""
    page = Page()
    stack = [page.add(-1, "#root", (), None)]
    text: list[str] = []
    link_at = 0  # height of the stack where a link was opened, 0 outside links
    html = html or ""
    pos, size = 0, len(html)
    match = _TOKEN.match

    def flush() -> None:
        if text:
            run = " ".join("".join(text).split())
            text.clear()
            if run:
                page.runs.append((stack[-1], run))

    def close_to(height: int) -> None:
        nonlocal link_at
        flush()
        del stack[height:]
        if link_at > len(stack):
            link_at = 0

    def close_open(kinds: tuple[str, ...], within: tuple[str, ...]) -> None:
        for h in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[h]]
            if tag in kinds:
                close_to(h)
                return
            if tag in within:
                return

    while pos < size:
        m = match(html, pos)
        pos = m.end()
        start = m[2]
        if start is None:
            end = m[1]
            if end is None:
                piece = m[0]
                if piece[0] == "<" and len(piece) > 1:
                    continue
                piece = unescape(piece)
                text.append(piece)
                if len(piece) > 1 or not piece.isspace():
                    n = len(piece.strip())
                    page.chars[stack[-1]] += n
                    if link_at:
                        page.linked[stack[-1]] += n
                continue
            end = end.lower()
            if end == "a":
                link_at = 0
            elif end == "br":
                text.append(" ")
            elif end not in INLINE:
                for h in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[h]] == end:
                        close_to(h)
                        break
            continue
        tag = start.lower()
        if tag in INLINE:
            if tag == "a":
                link_at = len(stack)
            elif tag == "br":
                text.append(" ")
            continue
        if tag in ENDS_P:
            close_open(("p",), ("button", "table", "td", "th"))
        if tag in ENDS_SAME:
            close_open(*ENDS_SAME[tag])
        flush()
        names, label = _attributes(m[3]) if m[3] else ((), None)
        node = page.add(stack[-1], tag, names, label)
        if tag in VOID:
            continue
        if tag in TEXT_ONLY:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            inner = html[pos : close.start()] if close else html[pos:]
            pos = close.start() if close else size
            if tag not in RAW:
                run = " ".join(unescape(inner).split())
                page.chars[node] = len(run)
                if run:
                    page.runs.append((node, run))
            if close:
                pos = html.find(">", pos) + 1 or size
            continue
        if not m[3].endswith("/") or tag in ENDS_P:
            stack.append(node)
    flush()
    return page
