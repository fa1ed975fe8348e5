from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sextant.functions import fts, text
from sextant.functions.stem import portuguese


def test_normal_forms():
    assert text.normalize(" a \n b\t") == "a b"
    assert text.normalize_lines("a  b\n\n  \nc") == "a b\nc"
    assert text.hash_form("Straße ﬁ") == "strasse fi"
    assert text.chunk_form(" A\n ﬁ ") == "a fi" or text.chunk_form(" A\n ﬁ ") == "a ﬁ".casefold()
    assert text.slug("Seção Única – Art. 1º") == "secao-unica-art-1o"
    assert text.slug("!!!") == "secao" and text.slug(None) == "secao"
    assert len(text.slug("a" * 200)) == 80


def test_search_keywords():
    assert text.search_keywords("Quais as regras da RDC 327 para produtos de Cannabis com THC até 0,2%?") == "cannabis thc produtos 0 2"
    assert text.search_keywords("lei 9782 2019 de") == ""
    assert text.search_keywords(None) == ""
    assert text.search_keywords("um dois tres quatro cinco seis sete oito nove dez") == "dois tres quatro cinco seis sete oito nove"


def test_answer_keywords():
    assert text.answer_keywords("Limite de 0,2% de THC?") == ["0,2", "0.2", "limite", "0", "2", "thc"]
    assert text.answer_keywords("") == []


def test_line_score():
    k = text.answer_keywords("limite 0,2 thc 12")
    assert text.line_score("o limite é 0,2 de thc", k) == 2.0 + 1 + 0.25 * 2 + 1
    assert text.line_score("artigo 120", ["12"]) == 0
    assert text.line_score("", k) == 0


@given(st.text(max_size=80))
def test_slug_is_clean(s):
    assert set(text.slug(s)) <= set("abcdefghijklmnopqrstuvwxyz0123456789-")


def test_query_trees():
    q = fts.websearch('registro "prazo final" or -exclui árvore', language="simple")
    assert q.kind == "or" and q.parts[0].kind == "and" and q.parts[0].parts[1] == fts.Query("phrase", (("prazo", 0), ("final", 1)))
    assert q.parts[1].parts[0].kind == "not" and q.terms() == ["registro", "prazo", "final", "arvore"] and q.needs_term()
    assert fts.plain("a de") is None
    assert fts.any_of("um dois") == fts.Query("term", ("dois",))
    assert fts.websearch('"prazo de registro"', language="simple") == fts.Query("phrase", (("prazo", 0), ("registro", 2)))
    assert not fts.websearch("-prazo").needs_term() and not fts.websearch("alfa or -prazo").needs_term()


def plain_density(places):
    """Sum over the shortest stretches that hold every term, found by trying all."""
    if not places or any(not p for p in places):
        return 0.0
    every = sorted((p, t) for t, own in enumerate(places) for p in own)
    holds = lambda a, b: len({t for p, t in every if a <= p <= b}) == len(places)
    spots = [p for p, _ in every]
    covers = [(a, b) for a in spots for b in spots if holds(a, b) and not any((c, e) != (a, b) and a <= c and e <= b and holds(c, e) for c in spots for e in spots if c <= e)]
    return sum(1 / (1 + max(0, b - a + 1 - len(places))) for a, b in covers)


def test_cover_density(spark):
    import random

    r = random.Random(2)
    cases = [[[1], [2]], [[1], [4]], [[1, 10], [2]], [[5]], []]
    for _ in range(40):
        spots = r.sample(range(1, 30), r.randint(3, 12))
        terms = r.randint(1, 3)
        cases.append([sorted(spots[t::terms]) for t in range(terms)])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, places array<array<int>>")
    got = {x["i"]: x["score"] for x in df.select("i", fts.cover_density(F.col("places")).alias("score")).collect()}
    assert all(abs(got[i] - plain_density(c)) < 1e-9 for i, c in enumerate(cases))


def test_stems():
    # Words of the published vocabulary with their stems.
    words = "boataria boate boates boatos bobagem bobagens bobo boca bocado quilométricas quilômetros químicos quintais registros registro autorização autorizações rapidamente facilidade logia"
    stems = "boat boat boat boat bobag bobagens bob boc boc quilométr quilômetr químic quint registr registr autoriz autoriz rapid facil log"
    assert [portuguese(w) for w in words.split()] == stems.split()


def test_negation_and_phrases_over_stop_words(spark):
    docs = spark.createDataFrame([(1, "prazo de registro"), (2, "outro texto"), (3, "alfa"), (4, "prazo registro")], "chunk_id long, text string")
    ids = lambda q: sorted(r["chunk_id"] for r in fts.search(docs, fts.websearch(q), 10).collect())
    assert ids('"prazo de registro"') == [1] and ids('"prazo registro"') == [4]
    assert ids("-prazo") == [2, 3] and ids("alfa or -prazo") == [2, 3] and ids("outro or -alfa -prazo") == [2] and ids("registros") == [1, 4]


def test_search_frame(spark):
    docs = spark.createDataFrame([(1, "Prazo final do registro"), (2, "registro: final, prazo"), (3, "árvore"), (4, None), (5, "prazo final")], "chunk_id long, text string")
    ids = lambda q: [r["chunk_id"] for r in fts.search(docs, q, 10).orderBy("fts_rank").collect()]
    assert ids(fts.websearch('"prazo final"')) == [1, 5]
    assert sorted(ids(fts.plain("registro prazo"))) == [1, 2]
    assert ids(fts.plain("arvore")) == [3] == ids(fts.plain("ÁRVORE"))
    assert ids(fts.websearch("prazo -registro")) == [5]
    assert ids(None) == []
