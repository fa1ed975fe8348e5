"""Tokens, the stored inverted index, the vector index, and many questions at once."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import fts
from sextant.operators import retrieve
from sextant.operators.inverted import InvertedIndex, bucket_of
from sextant.operators.many import hybrid_many, text_top_many, vector_top_many
from sextant.operators.retrieve import Params
from sextant.operators.vector_index import VectorIndex
from sextant.scratch import new_path

TOKENS = [
    ("Straße søster Łódź Æsir œuvre þing", ["strasse", "soster", "lodz", "aesir", "oeuvre", "thing"]),
    ("ação " + unicodedata.normalize("NFD", "ação Ǽ"), ["acao", "acao", "ae"]),
    ("Привет ёлка ΣΊΣΥΦΟΣ हिन्दी 北京", ["привет", "елка", "σισυφοσ", "हिन्दी", "北京"]),
    ("0.2 1.2.3 1.5e-3 2.5mg 0,2 1º", ["0.2", "1.2.3", "1.5e-3", "2.5", "mg", "0", "2", "1o"]),
    ("auto-escola RDC-327 10-5 2024-01-15", ["auto-escola", "rdc-327", "10", "5", "2024", "01", "15"]),
    ("see http://www.Example.org/a/b?x=1, ftp://ex.com or ex-a.com/p.", ["see", "http://www.example.org/a/b?x=1,", "ftp://ex.com", "or", "ex-a.com/p."]),
    ("Mail foo.Bar+x@ex-a.com.br!", ["mail", "foo.bar+x@ex-a.com.br"]),
    ("a_b <c> d|e \x0b f g", ["a", "b", "c", "d", "e", "f", "g"]),
    ("", []),
    (None, None),
]


def test_token_classes_in_text_and_question(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    got = {r["i"]: r["lex"] for r in frame.select("i", fts.tokens(F.col("t")).alias("lex")).collect()}
    for i, (text, want) in enumerate(TOKENS):
        assert got[i] == want
        if text is not None:  # the question's side
            assert fts._TOKEN.findall(fts.fold(text)) == want


def test_folds_as_python_does_letter_by_letter(spark):
    """Also the short ways: plain ASCII, and texts without marks and double letters."""
    letters = [chr(c) for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000] + list(fts.DOUBLE) + ["x\u0301", "Ǽ\u0301", "plain Text", "só", None]
    frame = spark.createDataFrame([(x,) for x in letters if x is None or unicodedata.category(x[0]) != "Cn"], "t string")
    got = frame.select("t", fts.folded(F.col("t")).alias("f"), F.lower("t").alias("l")).collect()
    assert len(got) > 7000
    for r in got:  # where Java and Python agree on the lower case
        if r["t"] is None or r["l"] == r["t"].lower():
            assert r["f"] == (None if r["t"] is None else fts.fold(r["t"])), r["t"]


def test_arrow_batches_of_texts_are_bounded(spark, tmp_path):
    """A worker's memory goes by the batch, not by the rows of its task, and lexemes are numbered anew in each."""
    from pyspark.sql.functions import pandas_udf

    from sextant.plans.queries import table

    spark.createDataFrame([(i, "word " * 2000) for i in range(3000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    docs = table(spark, str(tmp_path), "documents")
    size = pandas_udf(lambda x: x.map(lambda _: len(x)), "int")
    assert docs.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 1000


@pytest.mark.parametrize(
    ("token", "words"),
    [("auto-escola", ["auto-escola", "auto", "escola"]), ("http://ex.com/a/b", ["ex.com/a/b", "ex.com", "/a/b"]), ("ftp://ex.com", ["ex.com"]), ("ex.com/p", ["ex.com/p", "ex.com", "/p"]), ("a-b@ex-a.com", ["a-b@ex-a.com"]), ("ex-a.com", ["ex-a.com"]), ("1.5e-3", ["1.5e-3"]), ("word", ["word"])],
)
def test_what_tokens_count_as(token, words):
    assert fts.counted_as(token) == words


def test_every_text_is_found_by_its_own_words(spark):
    texts = [t for t, _ in TOKENS if t]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    for i, t in enumerate(texts):
        for form in (unicodedata.normalize("NFC", t), unicodedata.normalize("NFD", t).upper()):
            bare = re.sub('[-"]', " ", form) if "http" not in t else form
            found = [r["chunk_id"] for r in fts.search(chunks, fts.plain(bare, language="simple"), 10, language="simple").collect()]
            assert str(i) in found or "-" in t, (t, form, found)


def test_tokens_of_hostile_texts_take_linear_time(spark):
    texts = [one * 300_000 for one in ("a.", "a-", "1.", "a@", "..a", "a+", "http://", "x/y", "-a-a ", "́")]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.select(F.sum(F.size(fts.tokens(F.col("t"))))).first()[0] > 0


def corpus(n, seed=1):
    chance = random.Random(seed)
    words = ["alfa", "beta", "gama", "delta", "ω", "straße", "co-op", "0.2"]
    rows = []
    for i in range(n):
        text = " ".join(chance.choices([*words, "comum"], weights=[1, 2, 1, 5, 1, 1, 1, 1, 30], k=chance.choice([1, 3, 20, 200])))
        rows.append((f"c{i:05d}", None if i % 97 == 5 else "" if i % 97 == 6 else text))
    return rows


QUERIES = ["alfa", "comum", "alfa beta", "alfa or beta", '"alfa beta" or gama', "delta -comum", "strasse 0.2", "co-op", "nada", "comum beta gama alfa", '"comum comum comum"']


@pytest.fixture(scope="module")
def indexed(spark):
    chunks = spark.createDataFrame(corpus(1500), "chunk_id string, text string").repartition(6).cache()
    return chunks, InvertedIndex.build(chunks, new_path(spark, "test-inverted"), "simple", buckets=8, segment=16)


@pytest.mark.parametrize("question", QUERIES)
@pytest.mark.parametrize("top", [5, 2000])
def test_index_gives_the_rows_of_a_plain_search(indexed, question, top):
    chunks, index = indexed
    query = fts.websearch(question, language="simple")
    assert index.top(query, top).collect() == fts.search(chunks, query, top, language="simple").collect()


def test_segments_are_skipped_and_buckets_pruned(spark, indexed):
    _, index = indexed
    read = []
    index.top(fts.any_of("comum", language="simple"), 5, read)
    assert sum(n for n, _ in read) < read[0][1] / 2
    plan = index.blocks(["comum"])._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(bucket_of(F.lit("comum"), 8)).first()[0]
    assert "bucket#" in plan and re.search(rf"PartitionFilters: \[[^\]]*= {bucket}\)|PartitionFilters: \[[^\]]*IN \({bucket}\)", plan) and "PushedFilters: [" in plan


def test_bounds_hold_for_every_chunk(indexed):
    chunks, index = indexed
    for question in QUERIES:
        query = fts.websearch(question, language="simple")
        if not query.needs_term():
            continue
        bounds = {r["segment"]: r["bound"] for r in index.bounds(query).collect()}
        where = {r["c"]: r["segment"] for r in index.blocks().select("segment", F.explode("chunk_ids").alias("c")).distinct().collect()}
        for r in fts.search(chunks, query, 5000, language="simple").collect():
            assert r["fts_score"] <= bounds[where[r["chunk_id"]]] + 1e-9


def test_index_holds_all_postings_and_stands_empty_tables(spark, indexed):
    chunks, index = indexed
    rows = lambda df: sorted((r["chunk_id"], r["lexeme"], list(r["positions"])) for r in df.collect())
    assert rows(index.postings()) == rows(fts.postings(chunks, language="simple"))
    none = InvertedIndex.build(chunks.where("false"), new_path(spark, "test-inverted"), "simple")
    assert none.top(fts.plain("alfa", language="simple"), 5).collect() == [] and none.postings().collect() == []
    with pytest.raises(ValueError, match="no use"):
        index.top(fts.websearch("-alfa", language="simple"), 5)
    assert index.top(None, 5).collect() == []


def test_tasks_of_the_index_get_as_much_text(spark):
    """Long texts don't all go to one task; a segment's number holds its task."""
    rows = [(f"c{i:04d}", "comum " * (2000 if i % 10 == 0 else 1)) for i in range(800)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = InvertedIndex.build(spark.createDataFrame(rows, "chunk_id string, text string"), new_path(spark, "test-inverted"), "simple", buckets=2, segment=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["n"] for r in index.blocks().groupBy(F.shiftright("segment", 32)).agg(F.sum("total").alias("n")).collect()]
    assert len(held) == 4 and sum(held) == 80 * 2000 + 720 and max(held) < 0.4 * sum(held)


def test_pieces_between_white_space_are_tokenised_as_whole_texts(spark):
    """The short way of the index against the column expression, also in white space that Java doesn't count."""
    chance = random.Random(3)
    signs = "aAbßéǽ\u0301.-@/:+_ \t\x0b\xa0\x1c 1०²文हि(),<\"ς"
    texts = ["".join(chance.choices(signs, k=chance.choice([0, 1, 5, 30, 200]))) for _ in range(500)] + [t for t, _ in TOKENS] + ["http://ex.com/a\xa0b/ de co-op- -x ex.com/."]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    for language in ("simple", "portuguese"):
        got = sorted((r["chunk_id"], r["lexeme"], p) for r in fts.postings(chunks, language=language).collect() for p in r["positions"])
        want = []
        for r in chunks.select("chunk_id", fts.tokens(F.col("text")).alias("lex")).collect():
            words = [fts.lexeme(w, language) for t in r["lex"] or [] for w in fts.counted_as(t)]
            want += [(r["chunk_id"], w, i + 1) for i, w in enumerate(words) if w]
        assert got == sorted(want)


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_vector_index_finds_what_it_was_calibrated_for(spark):
    r = np.random.default_rng(4)
    centers = r.normal(size=(30, 24))
    v = centers[r.integers(0, 30, 3000)] + 0.4 * r.normal(size=(3000, 24))
    v[::3] = v[0]  # a third of all rows is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0]), (9005, [None] * 24)]
    frame = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    index = VectorIndex.build(frame, new_path(spark, "test-cells"), cells=30)
    assert index.vectors().count() == 3000
    width = index.calibrated(0.9, 10)
    assert index.probes(width) < index.cells / 2  # these vectors fall into cells
    asked = frame.where("chunk_id % 50 = 0 AND chunk_id < 3000").withColumnRenamed("chunk_id", "query_id")
    exact = {(x["query_id"], x["chunk_id"]) for x in vector_top_many(frame, asked, 10).collect()}
    found = {(x["query_id"], x["chunk_id"]) for x in index.search_many(asked, 10, width).collect()}
    assert len(exact) == 600 and len(exact & found) >= 0.9 * len(exact)
    all_cells = {(x["query_id"], x["chunk_id"]) for x in index.search_many(asked, 10, 10_000).collect()}
    assert all_cells == exact
    some = index.candidates(v[1].tolist(), 40)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and 0 < some.count() < 3000
    index.add(spark.createDataFrame([(7777, v[1].tolist())], "chunk_id long, embedding array<double>"))
    near = retrieve.vector_top(index.candidates(v[1].tolist()), v[1].tolist(), 2, 9).collect()
    assert {x["chunk_id"] for x in near} == {1, 7777}
    assert index.candidates([0.0] * 24).count() == 0 and index.candidates([1.0]).count() == 0


def test_vector_index_of_nothing_and_of_one(spark):
    kind = "chunk_id long, embedding array<double>"
    empty = spark.createDataFrame([], kind)
    none = VectorIndex.build(empty, new_path(spark, "test-cells"))
    assert none.candidates([1.0, 2.0]).collect() == [] and none.calibrated() > 0
    assert vector_top_many(empty, empty.withColumnRenamed("chunk_id", "query_id"), 3).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0, 2.0])], kind), new_path(spark, "test-cells"))
    assert [r["chunk_id"] for r in one.candidates([2.0, 1.0]).collect()] == [1]


def test_many_questions_as_one_at_a_time(spark):
    rows = corpus(300, 2)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").cache()
    r = np.random.default_rng(2)
    vectors = {c: r.normal(size=8).tolist() for c, _ in rows}
    embeddings = spark.createDataFrame(list(vectors.items()), "chunk_id string, embedding array<double>")
    asked = ["alfa beta", "comum", "delta comum nada", "nada", "", None, "strasse", "alfa beta gama delta comum"]
    questions = spark.createDataFrame([(i, q, vectors[rows[i][0]] if i != 3 else None) for i, q in enumerate(asked)], "query_id int, question string, embedding array<double>")
    stored = fts.postings(chunks, language="simple")
    params = Params(7, 6, 60, 9)
    got = {}
    for x in hybrid_many(stored, embeddings, questions, params, "simple").orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["chunk_id"], x["fts_rank"], x["vec_rank"]))
    for i, q in enumerate(asked):
        one = Params(7, 0 if i == 3 else 6, 60, 9)
        want = retrieve.hybrid(chunks, embeddings, q or "", None if i == 3 else vectors[rows[i][0]], one, stored=stored, language="simple")
        assert got.get(i, []) == [(x["chunk_id"], x["fts_rank"], x["vec_rank"]) for x in want.orderBy(F.desc("rrf_score"), "chunk_id").collect()], q
    assert text_top_many(stored, questions.where("false"), 5, "simple").collect() == []


def test_many_questions_over_texts_in_small_batches(spark, monkeypatch):
    """Texts are read without stored postings, no pair of a question and a chunk is shuffled, and what is skipped changes nothing."""
    from sextant.operators import many

    monkeypatch.setattr(many, "QUESTIONS", 5)
    monkeypatch.setattr(many, "AT_ONCE", 64)
    chunks = spark.createDataFrame(corpus(600, 5), "chunk_id string, text string").repartition(3).cache()
    words = sorted({w for _, t in corpus(600, 5) for w in re.findall(r"[a-z]{3,}", t or "")})
    r = random.Random(5)
    asked = [" ".join(r.sample(words, r.randint(1, min(5, len(words))))) for _ in range(14)] + ["", None, "absentword", "comum absentword"]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        frame = text_top_many(None, questions, 4, "simple", chunks)
        got = {}
        for x in frame.orderBy("query_id", "fts_rank").collect():
            got.setdefault(x["query_id"], []).append((x["chunk_id"], x["fts_score"], x["fts_rank"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
    for i, q in enumerate(asked):
        forms = [fts.plain(q or "", language="simple"), *(f for _, f in retrieve.forms(q or "", language="simple")[1:])]
        want = fts.search_first(chunks, forms, 4, None, "simple").orderBy("fts_rank").collect()
        assert got.get(i, []) == [(x["chunk_id"], x["fts_score"], x["fts_rank"]) for x in want], q


def test_plain_rank_as_a_loop(spark):
    import math

    def brute(places, every):
        if every and len(places) > 1:
            left = 1.0
            for i in range(len(places)):
                for k in range(i):
                    for p in places[i]:
                        for q in places[k]:
                            if 0 < abs(p - q) <= 100:
                                left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
            return 1 - left
        return sum(sum(0.1 / (j + 1) ** 2 for j in range(len(p))) / 1.64493406685 for p in places) / len(places)

    chance = random.Random(3)
    rows = [[sorted(chance.sample(range(1, 300), chance.randrange(1, 9))) for _ in range(n)] for n in (1, 2, 3, 4)] + [[[1], [2]], [[1], [500]], [[5], [5]]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<array<int>>")
    for every in (True, False):
        got = {r["i"]: r["x"] for r in frame.select("i", fts.plain_rank(F.col("p"), every).alias("x")).collect()}
        assert all(abs(got[i] - brute(r, every)) < 1e-12 for i, r in enumerate(rows))


def test_embedded_search_as_brute_force(spark, sf_small):
    """The registered query, vectors and distances worked out in memory."""
    import hashlib

    from sextant.plans import queries

    def vector(text):
        out = np.zeros(64)
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        for word in plain.split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % 64] += 1 if h >> 63 else -1
        return out / max(np.sqrt((out * out).sum()), 1e-12)

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    q = vector("query: " + queries.LADDER)
    far = {}
    for i, t in texts.items():
        v = vector("passage: " + t).astype(np.float32).astype(float)
        if v.any():
            far[i] = round(1 - (v @ q) / (np.sqrt(v @ v) * np.sqrt(q @ q)), 6)
    want = sorted((d, i) for i, d in far.items())[: queries.N2]
    got = sorted((r["vec_distance"], r["chunk_id"]) for r in queries.embedded_search(spark, sf_small).collect())
    assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want], atol=2e-6)
