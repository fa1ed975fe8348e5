"""Full-text search over postings: lexemes with positions, query trees, matching and cover density.

Text and question go through one tokenizer: folding (case, accents, letters that stand for two), tokens of the classes that
TOKEN lists, and what each token counts as. Words are stemmed in a language and stop words left out; their
positions count. Numbers, addresses and mixed tokens stay as they are. Postings are made once, when chunks are
indexed, and stored; a search reads those of the query's lexemes alone, and matches and scores are column
expressions over a chunk's positions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stem import portuguese

# Letters that have no decomposition, as plain letters, and those that stand for two.
PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŋ": "n", "ŧ": "t", "ſ": "s", "ƒ": "f", "ƀ": "b", "ɨ": "i", "ς": "σ", "º": "o", "ª": "a"}
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Combining marks that are accents (vowel signs of other scripts are not).
ACCENTS = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]
#: The same as a regular expression, for Java and SQL.
MARKS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ACCENTS) + "]+"


def _folds() -> tuple[str, str]:
    """Lower-case letters that are a letter with accents, and that letter; with those of PLAIN."""
    found = dict(PLAIN)
    for c in map(chr, range(0xDF, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) < 0x370)
        if c.isalpha() and c.lower() == c and len(base) == 1 and base != c:
            found[c] = PLAIN.get(base, base)
    return "".join(found), "".join(found.values())


ACCENTED, FOLDED = _folds()
_TRANSLATED = str.maketrans(ACCENTED, FOLDED)
_MARKS = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ACCENTS) + "]+")
#: What fold() makes of each letter beyond lower case.
_PLAINED = {ord(c): "".join(DOUBLE.get(x, x) for x in _MARKS.sub("", c.translate(_TRANSLATED))) for c in {*ACCENTED, *DOUBLE, *(chr(x) for a, b in ACCENTS for x in range(a, b + 1))}}
# Tokens, of a folded text, the first that fits: mail addresses; addresses with a protocol; hosts, with a path or not;
# numbers with points; words with hyphens; words and numbers. The bounds are those of addresses (64, 63) or keep matching linear.
_HOST = r"(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}(?::[0-9]{1,5})?"
_PATH = r"/[^\s<>\"'()]{0,500}"
_LETTER, _INNER = r"[\p{L}]", r"[\p{L}\p{M}\p{N}]"
TOKEN = "|".join(
    [
        r"[a-z0-9][a-z0-9._+-]{0,63}@(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}",
        rf"[a-z]{{2,10}}://{_HOST}(?:{_PATH})?",
        rf"{_HOST}(?:{_PATH})?",
        r"[0-9]+(?:\.[0-9]+){1,16}(?:e[+-]?[0-9]+)?",
        rf"{_LETTER}{_INNER}*(?:-{_INNER}+){{1,16}}",
        rf"{_INNER}+",
    ]
)
# white space as in Java: ASCII's
_TOKEN = regex.compile(TOKEN.replace(r"\s", r" \t\n\x0b\f\r"))
#: Java's first try, which changes no match: a word after which no character of another class stands is a word.
_PLAIN_WORD = rf"{_INNER}++(?![._+@:-])|"
# Portuguese function words that are no lexemes, as the Snowball project lists them, accents folded.
STOP = frozenset(
    """de a o que e do da em um para com nao uma os no se na por mais as dos como mas ao ele das seu sua ou quando muito nos ja eu
tambem so pelo pela ate isso ela entre depois sem mesmo aos seus quem nas me esse eles voce essa num nem suas meu minha numa
pelos elas qual lhe deles essas esses pelas este dele tu te voces vos lhes meus minhas teu tua teus tuas nosso nossa nossos
nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo estou estamos estao estive esteve estivemos
estiveram estava estavamos estavam estivera estiveramos esteja estejamos estejam estivesse estivessemos estivessem estiver
estivermos estiverem hei ha havemos hao houve houvemos houveram houvera houveramos haja hajamos hajam houvesse houvessemos
houvessem houver houvermos houverem houverei houvera houveremos houverao houveria houveriamos houveriam sou somos sao era
eramos eram fui foi fomos foram fora foramos seja sejamos sejam fosse fossemos fossem for formos forem serei sera seremos
serao seria seriamos seriam tenho tem temos tinha tinhamos tinham tive teve tivemos tiveram tivera tiveramos tenha tenhamos
tenham tivesse tivessemos tivessem tiver tivermos tiverem terei tera teremos terao teria teriamos teriam""".split()
)
#: Languages: how a token becomes a lexeme.
LANGUAGES: dict[str, Callable[[str], str]] = {"portuguese": portuguese, "simple": str}


def fold(text: str) -> str:
    """Lower case, accents off, double letters written out."""
    return text.lower().translate(_PLAINED)


#: What the letters beyond translate() are known by, in lower case: marks, and letters that are or become one of DOUBLE.
_SELDOM = MARKS[:-2] + "".join([*DOUBLE, *(a for a, b in zip(ACCENTED, FOLDED, strict=True) if b in DOUBLE)]) + "]"


def folded(text: Column) -> Column:
    """fold() as a column. Plain ASCII is lower-cased only, and marks and double letters are looked for once before they are replaced."""
    lower = F.lower(text)
    letters = F.translate(lower, ACCENTED, FOLDED)
    out = F.regexp_replace(letters, MARKS, "")
    for one, two in DOUBLE.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return F.when(F.octet_length(text) == F.length(text), lower).when(lower.rlike(_SELDOM), out).otherwise(letters)


def tokens(text: Column) -> Column:
    """The tokens of a text in order."""
    return F.regexp_extract_all(folded(text), F.lit(_PLAIN_WORD + TOKEN), F.lit(0))


def counted_as(token: str) -> list[str]:
    """What a token counts as, at places one after another: an address also as its host and path, a word with hyphens also as its parts."""
    if "@" in token:
        return [token]
    if "/" in token:
        address = token.split("://", 1)[-1]
        host, slash, path = address.partition("/")
        return [address, host, slash + path] if slash else [address]
    if "-" in token and "." not in token:
        return [token, *token.split("-")]
    return [token]


def lexeme(word: str, language: str) -> str:
    """A word's stem, nothing for a stop word; what isn't all letters (and hyphens) stays as it is."""
    if word in STOP:
        return ""
    return LANGUAGES[language](word) if word.replace("-", "").isalpha() else word


#: ASCII signs that are no part of a word that they stand around.
_EDGE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def _tokens_of(piece: str) -> list[str]:
    """The tokens of lower-case text without ASCII white space."""
    plain = piece.translate(_PLAINED)
    return [plain] if plain.isalnum() else _TOKEN.findall(plain)


def _spread(which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another: place in which, and place of the element in what the lists hold."""
    n = size[which]
    own = np.repeat(np.arange(len(which)), n)
    return own, np.arange(len(own)) + np.repeat(begin[which] - (np.cumsum(n) - n), n)


def _meant(tokens: pa.Array, language: str) -> tuple[pa.Array, np.ndarray]:
    """The lexemes that different tokens count as, one after another (nothing for a stop word), and how many each token has."""
    word = pc.ascii_is_alnum(tokens)
    words = tokens.filter(word)
    if LANGUAGES[language] is str:
        words = pc.if_else(pc.is_in(words, pa.array(sorted(STOP))), "", words)
    else:
        words = pa.array([lexeme(w, language) for w in words.to_pylist()], pa.string())
    others = [[lexeme(w, language) for w in counted_as(t)] for t in tokens.filter(pc.invert(word)).to_pylist()]
    return _merged(word, words, others)


def _merged(first: pa.Array, ones: pa.Array, lists: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    """Where first holds, the next of ones, else all of the next of lists; with the number of each."""
    first = first.to_numpy(zero_copy_only=False)
    size = np.ones(len(first), np.int64)
    size[~first] = np.fromiter(map(len, lists), np.int64, len(lists))
    own = np.repeat(first, size)
    at = np.empty(len(own), np.int64)
    at[own], at[~own] = np.arange(len(ones)), np.arange(len(ones), len(own))
    return pa.concat_arrays([ones, pa.array([x for own in lists for x in own], pa.string())]).take(pa.array(at)), size


def _placed(batch: pa.RecordBatch, language: str, only: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row of the batch, lexeme number and place (from 1) of what the tokens of the texts (column low) count as, in the order of the texts; and the
    lexemes by number (only, where it is given: others are left out). They are those of the batch, so a worker's memory doesn't grow with its task.

    No token holds ASCII white space, so different pieces between white space are tokenised once a batch; most are a word and signs around it.
    """
    lists = pc.ascii_split_whitespace(batch.column("low"))
    pieces = pc.list_flatten(lists).dictionary_encode()
    bare = pc.ascii_trim(pieces.dictionary, characters=_EDGE)
    word = pc.ascii_is_alnum(bare)
    tokens, held = _merged(word, bare.filter(word), [_tokens_of(p) for p in pieces.dictionary.filter(pc.invert(word)).to_pylist()])
    tokens = tokens.dictionary_encode()
    lexemes, size = _meant(tokens.dictionary, language)
    lexemes = lexemes.dictionary_encode()
    names = lexemes.dictionary if only is None else only
    number = pc.index_in(lexemes.dictionary, names).fill_null(-1).to_numpy().astype(np.int64)
    number[pc.equal(lexemes.dictionary, "").to_numpy(zero_copy_only=False)] = -1
    # the lexemes of each piece, then those of each row
    own, at = _spread(tokens.indices.to_numpy(), np.cumsum(size) - size, size)
    flat, size = number[lexemes.indices.to_numpy()[at]], np.bincount(np.repeat(np.arange(len(held)), held)[own], minlength=len(held))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    own, at = _spread(pieces.indices.to_numpy(), np.cumsum(size) - size, size)
    own, what = row[own], flat[at]
    n = np.bincount(own, minlength=len(lists))
    place = np.arange(1, len(own) + 1) - (np.cumsum(n) - n)[own]
    real = what >= 0
    return own[real], what[real], place[real], names


def _posted(batch: pa.RecordBatch, language: str, only: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The same by row, lexeme, place."""
    own, what, place, names = _placed(batch, language, only)
    by = np.lexsort((what, own))
    return own[by], what[by], place[by], names


def _lists(begin: np.ndarray, n: int, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, n).astype(np.int32)), values)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lowered(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    return chunks.select(F.col(chunk_id).alias("chunk_id"), F.coalesce(F.lower(text), F.lit("")).alias("low"))


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", language: str = "portuguese", only: list[str] | None = None) -> DataFrame:
    """chunk_id, lexeme, positions (from 1, in order); only: of these lexemes.

    A chunk's postings are complete within its row, so nothing is shuffled.
    """
    wanted = None if only is None else pa.array(dict.fromkeys(only), pa.string())
    kind = chunks.schema[chunk_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, what, place, names = _posted(batch, language, wanted)
            first = _changes(own, what)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(own[first])), names.take(pa.array(what[first])), _lists(first, len(own), pa.array(place.astype(np.int32)))], names=["chunk_id", "lexeme", "positions"])

    return _lowered(chunks, chunk_id, text).mapInArrow(run, f"chunk_id {kind}, lexeme string, positions array<int>")


def places(chunks: DataFrame, terms: list[str], language: str = "portuguese") -> DataFrame:
    """chunk_id, places (map from those of terms that the chunk holds to their positions) of chunks that hold any: one pass, no shuffle."""
    wanted, kind = pa.array(dict.fromkeys(terms), pa.string()), chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, what, place, names = _posted(batch, language, wanted)
            first = _changes(own, what)
            chunk = _changes(own[first])
            values = _lists(first, len(own), pa.array(place.astype(np.int32)))
            maps = pa.MapArray.from_arrays(pa.array(np.append(chunk, len(first)).astype(np.int32)), names.take(pa.array(what[first])), values)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(own[first][chunk])), maps], names=["chunk_id", "places"])

    return _lowered(chunks, "chunk_id", "text").mapInArrow(run, f"chunk_id {kind}, places map<string, array<int>>")


@dataclass(frozen=True)
class Query:
    """kind: term (one lexeme), phrase (lexemes with their distance from the first), and, or, not."""

    kind: str
    parts: tuple = ()

    def terms(self) -> list[str]:
        """Lexemes that can make a chunk match."""
        return self._terms(False)

    def all_terms(self) -> list[str]:
        return self._terms(True)

    def _terms(self, negated: bool) -> list[str]:
        if self.kind == "term":
            return list(self.parts)
        if self.kind == "phrase":
            return list(dict.fromkeys(t for t, _ in self.parts))
        return list(dict.fromkeys(t for p in self.parts if negated or p.kind != "not" for t in p._terms(negated)))

    def needs_term(self) -> bool:
        """Whether only chunks that hold one of terms() can match."""
        if self.kind in ("term", "phrase"):
            return True
        needs = [p.needs_term() for p in self.parts]
        return any(needs) if self.kind == "and" else self.kind == "or" and all(needs)


def _units(text: str, fold_accents: bool, language: str) -> list[list[tuple[str, int]]]:
    """Of each token its lexemes with their places in the text; stop words keep theirs, tokens of stop words alone are left out."""
    out, place = [], 0
    for token in _TOKEN.findall(fold(text) if fold_accents else text.lower()):
        words = counted_as(token)
        unit = [(x, place + i) for i, w in enumerate(words) if (x := lexeme(w, language))]
        place += len(words)
        if unit:
            out.append(unit)
    return out


def _joined(kind: str, parts: list[Query | None]) -> Query | None:
    some = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not some else some[0] if len(some) == 1 else Query(kind, tuple(some))


def _unit(words: list[tuple[str, int]]) -> Query:
    """One lexeme, or several that stand as far apart as here."""
    return Query("term", (words[0][0],)) if len(words) == 1 else Query("phrase", tuple((t, i - words[0][1]) for t, i in words))


def plain(text: str, fold: bool = True, language: str = "portuguese") -> Query | None:
    """All tokens."""
    return _joined("and", [_unit(u) for u in _units(text, fold, language)])


def any_of(text: str, fold: bool = True, language: str = "portuguese") -> Query | None:
    """Any token."""
    return _joined("or", [_unit(u) for u in _units(text, fold, language)])


def websearch(text: str, fold: bool = True, language: str = "portuguese") -> Query | None:
    """All terms; "..." is a phrase (stop words in it are gaps), or makes alternatives, a leading - excludes."""
    branches: list[list[Query]] = [[]]
    for minus, phrase, bare in regex.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not minus and bare.casefold() == "or":
            branches.append([])
            continue
        words = [w for u in _units(phrase or bare, fold, language) for w in u]
        if words:
            branches[-1].append(Query("not", (_unit(words),)) if minus else _unit(words))
    return _joined("or", [_joined("and", b) for b in branches])


PARSERS = {"websearch": websearch, "plain": plain, "or": any_of}


def matches(query: Query, places: Column) -> Column:
    """Whether a chunk matches; places: map from lexeme to positions."""
    if query.kind == "term":
        return F.map_contains_key(places, query.parts[0])
    if query.kind == "phrase":
        (first, _), *rest = query.parts
        at = lambda t: F.coalesce(F.try_element_at(places, F.lit(t)), F.array().cast("array<int>"))
        return F.exists(at(first), lambda p: _all([F.array_contains(at(t), p + i) for t, i in rest]))
    if query.kind == "not":
        return ~matches(query.parts[0], places)
    every = [matches(p, places) for p in query.parts]
    return _all(every) if query.kind == "and" else ~_all([~x for x in every])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def cover_density(places: Column) -> Column:
    """Of an array of position arrays: the sum over the shortest stretches that hold every term of
    1 / (1 + words in between beyond the terms); 0 without terms."""
    n = F.size(places)
    stream = F.array_sort(F.flatten(F.transform(places, lambda own, t: F.transform(own, lambda p: F.struct(p.alias("p"), t.alias("t"))))))
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("begin"), F.lit(0.0).alias("score"))

    def step(state: Column, x: Column) -> Column:
        # the latest place of each term; the earliest of these begins the shortest stretch that ends here
        moved = F.struct(F.transform(state["last"], lambda p, i: F.when(i == x["t"], x["p"]).otherwise(p)).alias("last"), state["begin"].alias("old"), state["score"].alias("score"), x["p"].alias("end"))
        return F.get(F.transform(F.array(moved), lambda m: _grown(m, F.array_min(m["last"]), n)), F.lit(0))

    return F.aggregate(stream, start, step, lambda s: s["score"])


def _grown(moved: Column, begin: Column, n: Column) -> Column:
    new = begin > moved["old"]
    worth = F.lit(1.0) / (F.lit(1) + F.greatest(F.lit(0), moved["end"] - begin + 1 - n))
    return F.struct(moved["last"].alias("last"), F.greatest(begin, moved["old"]).alias("begin"), (moved["score"] + F.when(new, worth).otherwise(0.0)).alias("score"))


#: Fixed values of the plain rank: weight of a position, and how the weight of two falls with their distance; nothing beyond FAR.
WEIGHT, FAR = 0.1, 100


def _near(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(distance / F.lit(1.5) - F.lit(2.0)))


def plain_rank(places: Column, every: bool) -> Column:
    """The rank that goes by frequency and nearness, not by covers; places: array of position arrays.

    every (of several terms): 1 minus the product over pairs of positions of different terms of 1 - WEIGHT * sqrt(nearness).
    Otherwise the mean over terms of the sum of WEIGHT / j^2 over their positions, scaled to the limit of that sum.
    """
    pair = lambda p, q: F.when((F.abs(p - q) > 0) & (F.abs(p - q) <= FAR), F.log(F.lit(1.0) - F.lit(WEIGHT) * F.sqrt(_near(F.abs(p - q))))).otherwise(0.0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    # each position against those of the terms before its own
    logs = F.transform(places, lambda own, i: total(F.transform(own, lambda p: total(F.transform(F.flatten(F.slice(places, 1, i)), lambda q: pair(p, q))))))
    single = F.transform(places, lambda own: total(F.transform(own, lambda p, j: F.lit(WEIGHT) / ((j + 1) * (j + 1)))) / F.lit(1.64493406685))
    by_frequency = total(single) / F.size(places)
    return F.when(F.size(places) > 1, F.lit(1.0) - F.exp(total(logs))).otherwise(by_frequency) if every else by_frequency


def found_places(chunks: DataFrame, terms: list[str], every: bool, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """chunk_id, places (map from those of terms that the chunk holds to their positions) of the chunks that hold
    any, or of every chunk. stored: postings, of which only those of the terms are read; without, the texts are read once."""
    if stored is None:
        rows = places(chunks, terms, language)
    else:
        rows = stored.where(F.col("lexeme").isin(*terms)).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("places"))
    if every:
        none = F.map_from_entries(F.array().cast("array<struct<lexeme: string, positions: array<int>>>"))
        return chunks.select("chunk_id").join(rows, "chunk_id", "left").withColumn("places", F.coalesce("places", none))
    return rows if stored is None else rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def score(query: Query) -> Column:
    """Cover density of the query's own terms that a chunk (places) holds. Nine digits, so that ranks don't hang on the order of a sum."""
    own = F.filter(F.array(*(F.try_element_at("places", F.lit(t)) for t in query.terms())) if query.terms() else F.array().cast("array<array<int>>"), lambda p: p.isNotNull())
    return F.round(cover_density(own), 9)


def search_first(chunks: DataFrame, queries: list[Query | None], top: int, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """form (number of the query), chunk_id, fts_score, fts_rank: the best chunks of the first query that any chunk matches.

    All queries are matched and scored in one pass: the top rows by (query, score) hold what is wanted of the first
    one with a hit, and ranks are numbered on these rows alone. Ties go to the smaller id.
    """
    live = [(i, q) for i, q in enumerate(queries) if q is not None]
    if not live:
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        return chunks.sparkSession.createDataFrame([], f"form int, chunk_id {kind}, fts_score double, fts_rank int")
    terms = list(dict.fromkeys(t for _, q in live for t in q.all_terms()))
    rows = found_places(chunks, terms, not all(q.needs_term() for _, q in live), stored, language)
    hit = F.filter(F.array(*(F.struct(F.lit(i).alias("form"), F.when(matches(q, F.col("places")), score(q)).alias("fts_score")) for i, q in live)), lambda h: h["fts_score"].isNotNull())
    best = rows.select("chunk_id", F.explode(hit).alias("h")).select("h.form", "chunk_id", "h.fts_score").orderBy("form", F.desc("fts_score"), "chunk_id").limit(top)
    ranked = best.selectExpr("*", "min(form) OVER () AS taken", "cast(row_number() OVER (ORDER BY form, fts_score DESC, chunk_id) AS int) AS fts_rank")
    return ranked.where("form = taken").drop("taken")


def search(chunks: DataFrame, query: Query | None, top: int, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """chunk_id, fts_score, fts_rank of the best chunks."""
    return search_first(chunks, [query], top, stored, language).drop("form")
