"""Extractive answers: the best line of all sources with its neighbours."""

from __future__ import annotations

import re

from ..functions.text import answer_keywords, line_score

NUMBER_ALONE = re.compile(r"\d+\.?\s*")
BEFORE, AFTER, LONGEST, FALLBACK_LINES = 1, 3, 1200, 4


def _lines(source: dict) -> list[str]:
    return [line.rstrip() for line in (source.get("text") or "").strip().splitlines() if line.strip()]


def _window(lines: list[str], i: int) -> slice:
    """The lines around line i; a number on its own takes the "Art." before it along."""
    alone = lambda j: NUMBER_ALONE.fullmatch(lines[j].strip())
    article = lambda j: j >= 0 and lines[j].strip() == "Art."
    start = max(0, i - BEFORE)
    if not (article(i - 1) and alone(i)) and i >= 2 and alone(i - 1) and article(i - 2):
        start = i - 2
    return slice(start, min(len(lines), i + AFTER))


def extractive_answer(question: str, sources: list[dict]) -> tuple[str, list[str]]:
    """The snippet and the sid it cites; sources in their order, each with sid, text and rrf_score.

    The sources are the top_k rows of a retrieval, so this runs on the driver.
    """
    if not sources:
        return "", []
    keywords = answer_keywords(question)
    texts = [_lines(s) for s in sources]
    scored = [(line_score(line.casefold(), keywords), float(s.get("rrf_score") or 0.0), -si, -li) for si, s in enumerate(sources) for li, line in enumerate(texts[si])]
    best = max((k for k in scored if k[0] > 0), default=None)
    if best is None:
        return "\n".join(texts[0][:FALLBACK_LINES]).strip(), [sources[0].get("sid") or "S1"]
    si, li = -best[2], -best[3]
    snippet = "\n".join(texts[si][_window(texts[si], li)]).strip()
    if len(snippet) > LONGEST:
        snippet = snippet[:LONGEST].rstrip() + "…"
    return snippet, [sources[si].get("sid") or f"S{si + 1}"]
