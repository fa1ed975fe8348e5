"""HTML to sections: a small tree builder on the standard parser, and the headings extractor."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

from ..functions.text import hash_form, normalize, sha256, slug

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE = frozenset("script style noscript nav header footer aside".split())
# An opening tag ends an open one of these, as browsers do.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}} | {f"h{i}": {"p"} for i in range(1, 7)}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        """Elements below in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            one = stack.pop()
            yield one
            stack += [c for c in reversed(one.children) if isinstance(c, Element)]

    def find(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)

    def text(self, breaks: bool = False) -> str:
        """All strings below, trimmed, a space between them; with breaks each br is a line end."""
        out, stack = [], list(reversed(self.children))
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                out.append(one.strip())
            elif breaks and one.tag == "br":
                out.append("\n")
            else:
                stack += reversed(one.children)
        return " ".join(filter(None, out))

    def prune(self) -> Element:
        """Without navigation, scripts and the like."""
        stack = [self]
        while stack:
            one = stack.pop()
            one.children = [c for c in one.children if isinstance(c, str) or c.tag not in NOISE]
            stack += [c for c in one.children if isinstance(c, Element)]
        return self


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        while ends and self.open[-1].tag in ends:
            self.open.pop()
        one = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(one)
        if tag not in VOID:
            self.open.append(one)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def only_closed(html: str) -> str:
    """The page with every & that begins no reference with its semicolon written out, so that it is read as text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def parse(html: str | None, closed: bool = False) -> Element:
    """closed: a reference without its semicolon (&amp at a title's end, &copy=1) is text; browsers read the older ones."""
    builder = _Builder()
    builder.feed(only_closed(html or "") if closed else html or "")
    builder.close()
    return builder.root


@dataclass(frozen=True)
class Section:
    heading_level: int
    heading_text: str
    path: str
    parent_path: str | None
    text: str


def title_of(root: Element) -> str:
    for tag in ("title", "h1"):
        found = root.find(tag)
        if found is not None and normalize(found.text()):
            return normalize(found.text())
    return "Documento"


def content_hash(sections: list[Section]) -> str:
    return sha256("\n".join(hash_form(x) for s in sections for x in (s.heading_text, s.text)))


def sections_by_headings(root: Element, title: str, deepest: int = 3) -> list[Section]:
    """Sections under h1 to h(deepest); those without text are left out; without any the body is one.

    A section's text is what stands in its paragraphs and list items. A string counts once, also where an
    element that was never closed holds the next one.
    """
    body = (root.find("body") or root).prune()
    levels = {f"h{i}": i for i in range(1, deepest + 1)}
    out: list[Section] = []
    above: list[tuple[int, str]] = []
    level, heading, texts = 0, "", []

    def close() -> None:
        text = normalize(" ".join(texts))
        if not level or not text:
            return
        while above and above[-1][0] >= level:
            above.pop()
        own = f"h{level}-{slug(heading)}"
        parent = above[-1][1] if above else None
        path = f"{parent}/{own}" if parent else own
        above.append((level, path))
        out.append(Section(level, heading, path, parent, text))

    stack: list[tuple[Element | str, bool]] = [(body, False)]
    while stack:
        one, inside = stack.pop()
        if isinstance(one, str):
            if inside:
                texts.append(one)
        elif one.tag in levels:
            close()
            level, heading, texts = levels[one.tag], normalize(one.text()), []
        else:
            inside = inside or one.tag in ("p", "li")
            stack += [(c, inside) for c in reversed(one.children)]
    close()
    if out:
        return out
    whole = normalize(body.text())
    return [Section(1, title, f"h1-{slug(title)}", None, whole)] if whole else []


def extract(html: str | None, deepest: int = 3, closed: bool = False) -> tuple[str, list[Section]]:
    """The title and the sections; pages with a div of class "ato" are legal texts. closed: see parse."""
    root = parse(html, closed)
    title = title_of(root)
    act = next((e for e in root.walk() if e.tag == "div" and "ato" in e.attrs.get("class", "").split()), None)
    if act is not None:
        from .legal import sections_of_act

        found = sections_of_act(act)
        if found:
            return title, found
    return title, sections_by_headings(root, title, deepest)
