"""Sections of a legal act: preamble, chapters, sections, articles and annexes.

Lines are classified one by one and drive a small state machine. Levels: 1 chapter or annex, 2 centred
title, 3 section, 4 subsection or a title under a title, 5 article. Text between a heading and its
first article is gathered as closing notes. Of articles of one number the better copy stays, in the
place of the first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import normalize, slug
from .html import Element, Section

ROMAN = r"([IVXLC\d]+)\b"
# How headings of an act begin, and the line that is no part of it.
CHAPTER = re.compile(rf"CAP[ÍI]TULO\s+{ROMAN}", re.I)
SECTION = re.compile(rf"SE[CÇ][ÃA]O\s+{ROMAN}", re.I)
SUBSECTION = re.compile(rf"SUBSE[CÇ][ÃA]O\s+{ROMAN}", re.I)
ANNEX = re.compile(r"ANEXO(?:\s+[IVXLC\d]+)?(?:\s*[-–—:]\s*.*)?$", re.I)
#: The ordinal sign must stand at the number; a letter after a hyphen is part of it.
ARTICLE = re.compile(r"(?:Art\.|ART\.)\s*(\d+(?:-[A-Z])?)([º°]|[oO](?![^\W\d_]))?\.?\s*(.*)$", re.S)
NOTICE = re.compile(r"Este texto n[aã]o substitui a Publica[cç][aã]o Oficial\.?$", re.I)
# Headings and articles in the middle of a line.
GLUED = re.compile(rf"(?<=\S)\s*\b(?=(?:CAP[ÍI]TULO|Se[cç]ão|Subse[cç]ão)\s+{ROMAN}|ANEXO(?:\s+[IVXLC\d]+)?\b)", re.I)
EACH_ARTICLE = re.compile(r"(?<=\S)\s*\b(?=(?:Art\.|ART\.)\s*\d)")
BARE = re.compile(r"(?:Art\.|ART\.)$")
STRUCTURE_WORD = re.compile(r"\b(?:CAP[ÍI]TULO|Se[cç]ão|Subse[cç]ão|ANEXO)\b", re.I)
# How the head of an act begins; in capitals.
HEADERS = ("MINISTÉRIO DA SAÚDE", "MINISTERIO DA SAUDE", "AGÊNCIA NACIONAL DE VIGILÂNCIA SANITÁRIA", "AGENCIA NACIONAL DE VIGILANCIA SANITARIA", "DIRETORIA COLEGIADA", "RESOLUÇÃO DA DIRETORIA COLEGIADA", "RESOLUCAO DA DIRETORIA COLEGIADA")
#: Pieces that one line is cut into at most by headings; characters of an article's end that are looked at.
PIECES, TAIL = 10, 220


def table_text(table: Element) -> str:
    rows = [[normalize(c.text()) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    return "\n".join(" | ".join(filter(None, r)) for r in rows if any(r))


def blocks(root: Element):
    """Paragraphs outside tables, and tables, in order."""
    for child in root.children:
        if isinstance(child, Element):
            if child.tag in ("p", "table"):
                yield child
            else:
                yield from blocks(child)


def lines_of(block: Element, carried: str) -> tuple[list[str], str]:
    """The lines of a paragraph; headings and articles in mid-line begin lines of their own, and an "Art." at the
    end waits for its number."""
    raw = [normalize(x) for x in block.text(breaks=True).split("\n")]
    parts = [p for line in raw if line for p in GLUED.sub("\n", line, count=PIECES - 1).split("\n")]
    lines = [q.strip() for p in parts for q in EACH_ARTICLE.sub("\n", p).split("\n") if q.strip()]
    out: list[str] = []
    for line in lines:
        if carried:
            if line[:1].isdigit():
                line = f"{carried} {line}"
            else:
                out.append(carried)
            carried = ""
        if BARE.match(line):
            carried = line
        elif re.search(r"\s(?:Art\.|ART\.)$", line):
            head, _, carried = line.rpartition(" ")
            out.append(head)
        else:
            out.append(line)
    return out, carried


def centred(block: Element, line: str) -> bool:
    style = block.attrs.get("style", "").replace(" ", "").lower()
    return ("text-align:center" in style or block.attrs.get("align", "").lower() == "center") and 3 <= len(line) <= 140 and len(line.split()) <= 14 and not ARTICLE.match(line)


def article_worth(s: Section) -> tuple[int, int, int]:
    """Deeper, no heading stuck to its end, longer."""
    last = s.text.splitlines()[-1] if s.text else ""
    return s.path.count("/"), -bool(STRUCTURE_WORD.search(normalize(last)[-TAIL:])), len(s.text)


def header_of(line: str) -> str | None:
    """The head of an act that a line begins with."""
    return next((h for h in HEADERS if line.upper().startswith(h)), None)


@dataclass
class _Act:
    sections: list[Section] = field(default_factory=list)
    stack: list[tuple[int, str]] = field(default_factory=list)
    articles: dict[str, int] = field(default_factory=dict)
    paths: set[str] = field(default_factory=set)
    kind: str = "preamble"
    head: tuple[int, str, str, str | None] | None = None
    number: str = ""
    text: list[str] = field(default_factory=list)
    over: bool = False
    headers: set[str] = field(default_factory=set)

    def unique(self, path: str) -> str:
        n, own = 2, path
        while own in self.paths:
            own, n = f"{path}-{n}", n + 1
        self.paths.add(own)
        return own

    def flush(self) -> None:
        text = "\n".join(self.text).strip()
        self.text = []
        if self.kind == "preamble":
            if text:
                self.put(Section(1, "Preâmbulo", "preambulo", None, text))
        elif self.kind == "heading":
            if text:
                parent = self.stack[-1][1] if self.stack else None
                base = "notas-finais"
                self.put(Section(min(6, (self.stack[-1][0] if self.stack else 0) + 1), "Notas finais", f"{parent}/{base}" if parent else base, parent, text))
        elif self.head is not None:
            level, heading, path, parent = self.head
            if self.kind == "article":
                self.put_article(Section(level, heading, path, parent, text or heading))
            elif text:
                self.put(Section(level, heading, f"{path}/conteudo", parent, text))
        self.kind, self.head = "heading", None

    def put(self, s: Section) -> None:
        self.sections.append(Section(s.heading_level, s.heading_text, self.unique(s.path), s.parent_path, s.text))

    def put_article(self, s: Section) -> None:
        at = self.articles.get(self.number)
        if at is None:
            self.articles[self.number] = len(self.sections)
            self.put(s)
        elif article_worth(s) > article_worth(self.sections[at]):
            old = self.sections[at]
            self.sections[at] = Section(s.heading_level, s.heading_text, old.path, old.parent_path, s.text)

    def heading(self, level: int, text: str) -> None:
        """Open a heading; the same structural heading again, outside the preamble, begins the document anew."""
        started = self.kind != "preamble"
        self.flush()
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        parent = self.stack[-1][1] if self.stack else None
        path = f"{parent}/{slug(text)}" if parent else slug(text)
        if path in self.paths and started and level in (1, 3) and not ANNEX.match(text):
            self.over = True
            return
        path = self.unique(path)
        self.stack.append((level, path))
        self.sections.append(Section(level, text, path, parent, ""))

    def line(self, line: str, block: Element) -> None:
        if NOTICE.match(line):
            return
        head = header_of(line)
        if head and (self.kind == "annex" and head in HEADERS[:4] or self.kind != "preamble" and head in self.headers and centred(block, line)):
            self.over = True  # the page holds the act twice
            return
        if head:
            self.headers.add(head)
        article = ARTICLE.match(line)
        if article:
            if self.kind == "annex":
                self.text.append(line)
                return
            self.flush()
            self.number = article[1]
            parent = self.stack[-1][1] if self.stack else None
            own = f"art-{article[1].lower()}"
            self.kind, self.head = "article", (5, f"Art. {article[1]}", f"{parent}/{own}" if parent else own, parent)
            self.text = [line]
        elif CHAPTER.match(line):
            if self.kind == "annex":
                self.over = True
                return
            self.heading(1, line)
        elif SUBSECTION.match(line):
            self.heading(4, line)
        elif SECTION.match(line):
            self.heading(3, line)
        elif ANNEX.match(line):
            self.flush()
            self.stack = []
            self.heading(1, line)
            self.kind, self.head = "annex", (1, line, self.stack[-1][1] if self.stack else slug(line), None)
        elif self.kind not in ("annex", "preamble") and centred(block, line):
            self.heading(4 if self.stack and self.stack[-1][0] == 2 else 2, line)
        else:
            self.text.append(line)


def sections_of_act(root: Element) -> list[Section]:
    act, carried = _Act(), ""
    for block in blocks(root):
        if block.tag == "table":
            text = table_text(block)
            if text:
                act.text.append(text)
            continue
        lines, carried = lines_of(block, carried)
        for line in lines:
            act.line(line, block)
            if act.over:
                break
        if act.over:
            break
    if carried and not act.over:
        act.text.append(carried)
    act.flush()
    return act.sections


def article_warning(root: Element, sections: list[Section]) -> bool:
    """Whether suspiciously few articles were found for those that paragraphs which begin with one name."""
    texts = [normalize(p.text()) for p in root.walk() if p.tag == "p"]
    hint = sum(max(1, len(re.findall(r"\b(?:Art\.|ART\.)\s*\d+", t))) for t in texts if t.startswith(("Art.", "ART.")))
    got = sum(s.heading_level == 5 for s in sections)
    return hint >= 10 and got < max(5, int(0.4 * hint))
