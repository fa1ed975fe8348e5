"""Main text of web pages by a maximum-scoring subsequence (operator 11).

A page is a sequence of words and tags. Words score positive and tags negative; the contiguous run of the greatest
sum is where the content is, and one linear scan finds it. The weights are learnt from labelled pages, which are
those that mark their article themselves (exactly one outermost <article>, or else <main>): a word's weight depends on
the block it stands in (long or short, heading, link), a tag's on its name, and each is the log-odds of standing
inside the marked article, cut to its sign. Pages without such a mark are scored by what the others taught.

The best run is then brought to the bounds of the page's own structure: to the <article> that makes up most of it, to the <main>
around it, or else to the deepest of HOLDERS that holds all of it, and to a heading right before it; blocks
that are mostly links don't join that way. Elements that say that they are no content (PARTS, ROLES, NAMES: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments, and what is hidden) neither score nor stay. Of a header
inside an article the headings stay.

A block is the text between two block-level tags, with white space (Unicode's) turned into single spaces; a line
break is white space. Character references are decoded as HTML does, also without their semicolon. Tags that are never
closed, closed twice or crossed are read as browsers read them, as far as text and blocks go; what is nested deeper
than DEPTH counts as standing at that depth. A null or empty page, or one that holds no content, has the empty text. Rows are read one by one,
so repeated rows, null ids and urls pass through; columns named text or n_chars are replaced, all others kept. Pages
are read whole, one at a time, in time proportional to their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import prepare, replaced, trim, with_columns

DEPTH = 512
# fixed values of HTML
RAW = "script style textarea title xmp iframe noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big br button canvas cite code data del dfn em font i iframe img input ins kbd label link mark meta meter noscript object output picture progress q rp rt ruby s samp script select small source span strike strong style sub sup svg template textarea time title tt u var video wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag of the first kind closes an open one of the second, in the same list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
#: Where the search for an element to close ends.
SCOPES = frozenset("ul ol dl table td th select body html article section div".split())
CELLS = frozenset("td th table".split())
#: Elements that a whole text may fill.
HOLDERS = frozenset("article main section div center td details".split())
ROWS = frozenset("tr tbody thead tfoot table body html".split())
# elements, roles and names that no main text stands in
PARTS = frozenset("head nav footer aside form button select label dialog template noscript svg math object canvas audio video menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login register paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead comment comments commentlist disqus discussion respond reply replies share sharing social related recommended recommendations pagination pager paging toolbar search searchbox skip".split()
)
#: What keeps an element's text out: nothing, standing in a header of an article (its headings stay), in a form (an article or main in it
#: stays), in what only its name makes a part (a main in it stays), or in any other part.
CONTENT, HEADER, FORM, NAMED, PART = range(5)
COMMENTS = frozenset("comment comments commentlist reply replies".split())
#: Before a name of NAMES: says that the element has or lacks such a part, not that it is one. At the end: says what state a part is in.
NOT_ITSELF = frozenset("has have with no without is not hide show".split())
STATES = frozenset("open opened visible enabled disabled active on off ready loaded collapsed expanded".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z][^>]*>?|<[!?][^>]*>?"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/<>]*)(?P<rest2>[^<>]*)>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|itemprop|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Weights where no page is labelled, and of tags that no labelled page has.
BLOCK_TAG, INLINE_TAG = -1.0, -0.1
WORD_KINDS = ("long", "middle", "short", "heading", "link")
PRIOR = {"long": 1.0, "middle": 0.6, "short": 0.3, "heading": 0.6, "link": 0.05}
LEAST_WORD, MOST_WORD, LEAST_TAG = 0.05, 3.0, -4.0


def word_kind(n: int, heading: bool) -> str:
    return "heading" if heading else "long" if n > 15 else "middle" if n > 4 else "short"


def kept_out(name: str, rest: str) -> int:
    """Why an element that stands in content holds no main text: CONTENT if it may."""
    found = FORM if name == "form" else PART if name in PARTS else HEADER if name == "header" else CONTENT
    if found == PART or not rest:
        return found
    words: list[str] = []
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and INVISIBLE.search(value)):
            return PART
        if key == "role" and value.strip().lower() in ROLES:
            return max(found, FORM if value.strip().lower() == "form" else PART)
        if key in ("class", "id", "aria-label", "itemprop"):
            for one in value.split():
                own = WORDS.findall(CAMEL.sub(" ", one).lower())
                own = own[: next((i for i, w in enumerate(own) if w in NOT_ITSELF), len(own))]
                if own and own[-1] not in STATES:
                    words += own
    if name in ("html", "body", "main"):
        return found
    if not COMMENTS.isdisjoint(words):
        return PART
    if name != "article" and not NAMES.isdisjoint(words):
        return NAMED
    return found or (HEADER if "header" in words and name != "article" else CONTENT)


class Frame:
    """An open element; number is -1 for an inline one."""

    __slots__ = ("name", "number", "state", "link", "heading", "article", "main", "owner")

    def __init__(self, name: str, above: Frame | None):
        self.name, self.number = name, -1
        self.state, self.link, self.heading, self.article, self.main, self.owner = (above.state, above.link, above.heading, above.article, above.main, above.owner) if above else (CONTENT, False, False, False, False, 0)

    def enter(self, why: int) -> None:
        """Take up what the element itself says."""
        name = self.name
        if self.state == PART:
            return
        if why > HEADER:
            self.state = max(why, self.state) if self.state > HEADER else why
        elif why == HEADER:
            self.state = HEADER if self.state == CONTENT and (self.article or self.main) else PART
        elif name == "article" and self.article:  # an article in an article is a comment on it
            self.state = PART
        elif (self.state == FORM and name in ("article", "main")) or (self.state == NAMED and name == "main") or (self.state == HEADER and name in HEADINGS):
            self.state = CONTENT


class Page:
    """Blocks of a page in order, and the elements they stand in. Without weights it counts words and tags instead."""

    def __init__(self, source: str, weights: dict[str, float] | None = None):
        self.texts: list[str] = []
        self.scores: list[float] = []  # of the words of each block
        self.costs: list[float] = []  # of the tags before each block
        self.linked: list[bool] = []  # mostly links
        self.heading: list[bool] = []
        self.inside: list[int] = []  # number of the innermost block-level element
        # of each block-level element: the one around it, its name, its first block and the one after its last
        self.up, self.names, self.first, self.end = [-1], ["#page"], [0], [0]
        self.counts: dict[tuple[bool, bool], Counter] = {}  # by (in an article, in main)
        self.articles = self.mains = 0
        self.learning = weights is None
        self.weights = weights or {}
        self.stack = [Frame("#page", None)]
        self.stack[0].number = 0
        self.paragraphs = 0  # open ones
        self._start_block()
        self.cost = 0.0
        self._read(source)

    def _start_block(self) -> None:
        self.parts: list[str] = []
        self.plain = self.links = 0

    def _count(self, state: int, where: Frame, feature: str, n: int = 1) -> None:
        own = state == CONTENT
        self.counts.setdefault((own and where.article, own and where.main), Counter())[feature] += n

    def _block_over(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            kind = word_kind(self.plain + self.links, top.heading)
            if self.learning:
                self._count(CONTENT, top, kind, self.plain)
                self._count(CONTENT, top, "link", self.links)
            weight = self.weights.get
            self.texts.append(text)
            self.scores.append(self.plain * weight(kind, 0.0) + self.links * weight("link", 0.0))
            self.costs.append(self.cost)
            self.linked.append(2 * self.links > self.plain + self.links)
            self.heading.append(top.heading)
            self.inside.append(top.owner)
            self.cost = 0.0
        self._start_block()

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text.split())
        if top.state != CONTENT:
            if self.learning and n:
                self._count(top.state, top, "link" if top.link else word_kind(n, top.heading), n)
            return
        self.parts.append(text)
        if top.link:
            self.links += n
        else:
            self.plain += n

    def _close_to(self, k: int) -> None:
        """Close the elements from number k of the stack on."""
        while len(self.stack) > k:
            frame = self.stack.pop()
            if frame.number >= 0:
                self.end[frame.number] = len(self.texts)
            if frame.name == "p":
                self.paragraphs -= 1

    def _find(self, names, stops) -> int:
        """Number in the stack of the innermost element of these names, 0 if one of stops is met before."""
        k = len(self.stack) - 1
        while k > 0 and self.stack[k].name not in names:
            if stops(self.stack[k]):
                return 0
            k -= 1
        return k

    def _read(self, source: str) -> None:
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is not None:  # else a comment, a declaration, or an element whose content is no text
                self._tag(name.lower(), bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or "")
        if at < len(source):
            self._text(source[at:])
        self._block_over()
        self._close_to(0)

    def _tag(self, name: str, closing: bool, rest: str) -> None:
        block = name in BLOCKS
        top = self.stack[-1]
        if block:
            self._block_over()
        elif name == "br" and top.state == CONTENT:
            self.parts.append(" ")
        feature = f"<{name}" if block or name in INLINE else "<?"
        if self.learning:
            self._count(top.state, top, feature)
        elif top.state == CONTENT:
            self.cost += self.weights.get(feature, BLOCK_TAG if block else INLINE_TAG)
        if closing:
            if not block:
                k = self._find((name,), lambda f: f.number >= 0)
            elif name in ROWS:
                k = self._find((name,), lambda f: False)
            else:
                k = self._find((name,), lambda f: f.name in CELLS)
            if k:
                self._close_to(k)
            return
        if name in VOID:
            return
        if block and self.paragraphs and (k := self._find(("p",), lambda f: f.name in CELLS)):
            self._close_to(k)
        if name in CLOSES:
            while k := self._find(CLOSES[name], lambda f: f.name in SCOPES):
                self._close_to(k)
        if len(self.stack) >= DEPTH:
            return
        frame = Frame(name, self.stack[-1])
        frame.enter(kept_out(name, rest) if frame.state != PART else PART)
        frame.link |= name == "a"
        if block:
            frame.number = len(self.names)
            self.up.append(frame.owner)
            frame.owner = frame.number
            self.names.append(name)
            self.first.append(len(self.texts))
            self.end.append(len(self.texts))
            frame.heading |= name in HEADINGS
        if frame.state == CONTENT:
            self.articles += name == "article" and not frame.article
            self.mains += name == "main" and not frame.main
            frame.article |= name == "article"
            frame.main |= name == "main"
        self.paragraphs += name == "p"
        self.stack.append(frame)

    def best_run(self) -> tuple[int, int] | None:
        """First and last block of the run of the greatest sum; of equal sums the first and longest."""
        best, found, total, start = 0.0, None, 0.0, 0
        for k, (words, tags) in enumerate(zip(self.scores, self.costs, strict=True)):
            total += tags
            if k == 0 or total < 0:
                total, start = 0.0, k
            total += words
            if total > best or (total == best and found and found[0] == start):
                best, found = total, (start, k)
        return found

    def holder(self, first: int, last: int) -> int:
        """Number of the element to whose bounds a run is brought, 0 if that is the page: of the articles that the run reaches the one of
        the greatest score, if what stands outside of all doesn't exceed it; else main, or the deepest element that holds the run."""
        article = [0]  # the outermost one around each element
        for e in range(1, len(self.names)):
            article.append(article[self.up[e]] or (e if self.names[e] == "article" else 0))
        score = Counter()
        for k in range(first, last + 1):
            score[article[self.inside[k]]] += self.scores[k]
        outside = score.pop(0, 0.0)
        if score:
            best = max(score, key=lambda e: (score[e], -e))
            if score[best] >= outside:
                return best
        above, inner = [], self.inside[first]
        while inner > 0:
            if self.names[inner] in HOLDERS and self.first[inner] <= first and last < self.end[inner]:
                above.append(inner)
            inner = self.up[inner]
        mains = [e for e in above if self.names[e] == "main"]
        if mains:
            return mains[-1]
        return above[0] if above else 0

    def main_text(self) -> str:
        run = self.best_run()
        if run is None:
            return ""
        first, last = run
        around = self.holder(first, last)
        marked = self.names[around] in ("article", "main")
        begin, end = (self.first[around], self.end[around]) if around else (first, last + 1)
        kept = [k for k in range(begin, end) if marked or first <= k <= last or not self.linked[k]]
        while not marked and begin and self.heading[begin - 1]:
            begin -= 1
            kept.insert(0, begin)
        return "\n".join(self.texts[k] for k in kept)

    def labelled(self) -> tuple[Counter, Counter]:
        """Counts inside and outside the article that the page marks; both empty if it marks none or several."""
        which = 0 if self.articles == 1 else 1 if self.articles == 0 and self.mains == 1 else None
        inside, outside = Counter(), Counter()
        if which is not None:
            for where, found in self.counts.items():
                (inside if where[which] else outside).update(found)
        return inside, outside


def counted(pages: DataFrame, source: str = "html") -> DataFrame:
    """feature, inside, outside: tokens of the labelled pages by where they stand; a row for each kind of word and known tag name."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = Page(text or "").labelled()
                inside.update(own[0])
                outside.update(own[1])
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], names=["feature", "inside", "outside"])
        trim()

    found = pages.select(F.col(source).cast("string").alias("html")).mapInArrow(run, "feature string, inside long, outside long")
    return found.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of standing inside, words above 0 and tags below; the built-in weights where there are no labels."""
    if not any(i for i, _ in counts.values()) or not any(o for _, o in counts.values()):
        return dict(PRIOR)
    out = {}
    for feature in {*counts, *WORD_KINDS}:
        i, o = counts.get(feature, (0, 0))
        odds = math.log((i + 1) / (o + 1))
        out[feature] = min(max(odds, LEAST_TAG), 0.0) if feature.startswith("<") else min(max(odds, LEAST_WORD), MOST_WORD)
    return out


def learn(pages: DataFrame, source: str = "html") -> dict[str, float]:
    """Weights of word kinds and tag names (BLOCKS and INLINE bound their number), counted over all pages."""
    return weights_of({r["feature"]: (r["inside"], r["outside"]) for r in counted(pages, source).collect()})


def extract(pages: DataFrame, weights: dict[str, float], source: str = "html") -> DataFrame:
    """pages with text, the main text, and n_chars, its code points."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(text or "", weights).main_text() for text in batch.column(source).cast(pa.string()).to_pylist()]
            yield replaced(batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})
        trim()

    return pages.mapInArrow(run, with_columns(pages.schema, [("text", T.StringType()), ("n_chars", T.LongType())]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", "text", "n_chars")


#: For pages that mark one article and no other part inside it, as those of the given tables do.
OP11_SQL = r"""
WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article\b[^>]*>(.*)</article>', 1) AS x FROM pages),
lines AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(10), ' '), '(?i)<br\b[^>]*>', ' ', 'g'), '(?i)</?(?:p|h[1-6]|li|ul|div|td|tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS y FROM cut),
texts AS (
  SELECT page_id, url, list_filter(list_transform(y, lambda l: trim(regexp_replace(
    regexp_replace(replace(replace(regexp_replace(l, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda l: l <> '') AS z
  FROM lines)
SELECT page_id, url, array_to_string(z, chr(10)) AS text, length(array_to_string(z, chr(10)))::BIGINT AS n_chars FROM texts
"""
