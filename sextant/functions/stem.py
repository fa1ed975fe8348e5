"""The published Snowball stemmer for Portuguese, on lower-case words.

Regions: R1 follows the first consonant after a vowel, R2 is the same inside R1, RV follows the next vowel
after an initial consonant pair, the next consonant after two vowels, or else the third letter.
"""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouáéíóúâêô"
# The suffixes of the algorithm's steps.
DELETED = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam
em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas
es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis
ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos
ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split()
RESIDUAL = "os a i o á í ó".split()
BEFORE_MENTE, BEFORE_IDADE, BEFORE_AMENTE = ("ante", "avel", "ível"), ("abil", "ic", "iv"), ("os", "ic", "ad")


def _behind(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from start on."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        at = next((i for i in range(2, len(word)) if word[i] in VOWELS), None)
    elif word[0] in VOWELS:
        at = next((i for i in range(2, len(word)) if word[i] not in VOWELS), None)
    else:
        return 3
    return len(word) if at is None else at + 1


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _standard(w: str, r1: int, r2: int, rv: int) -> str:
    """Step 1: a standard suffix goes, or is replaced; the word as it is if none fits."""

    def without(word: str, endings: tuple[str, ...]) -> str:
        end = _longest(word, endings)
        return word[: -len(end)] if end and len(word) - len(end) >= r2 else word

    found = _longest(w, [*DELETED, *REPLACED, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"])
    if not found:
        return w
    at = len(w) - len(found)
    stem = w[:at]
    if found in ("ira", "iras"):
        return stem + "ir" if at >= rv and stem.endswith("e") else w
    if found == "amente":
        if at < r1:
            return w
        cut = without(stem, ("iv",))
        return without(cut, ("at",)) if cut != stem else without(stem, BEFORE_AMENTE)
    if at < r2:
        return w
    if found in REPLACED:
        return stem + REPLACED[found]
    if found == "mente":
        return without(stem, BEFORE_MENTE)
    if found.startswith("idade"):
        return without(stem, BEFORE_IDADE)
    if found.startswith("iv"):
        return without(stem, ("at",))
    return stem


@lru_cache(1 << 16)
def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _behind(w, 0)
    r2, rv = _behind(w, r1), _rv(w)
    new = _standard(w, r1, r2, rv)
    if new == w:
        end = _longest(w[rv:], VERBS)
        new = w[: len(w) - len(end)]
    if new != w:
        if len(new) - 1 >= rv and new.endswith("ci"):
            new = new[:-1]
    else:
        end = _longest(w[rv:], RESIDUAL)
        new = w[: len(w) - len(end)]
    if new.endswith(("e", "é", "ê")) and len(new) - 1 >= rv:
        new = new[:-1]
        if new.endswith(("gu", "ci")) and len(new) - 1 >= rv:
            new = new[:-1]
    elif new.endswith("ç"):
        new = new[:-1] + "c"
    return new.replace("a~", "ã").replace("o~", "õ")
