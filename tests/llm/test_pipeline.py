"""The pipeline against its stages worked out apart."""

import hashlib
import re
import zlib

import numpy as np

import corpus_pipeline
from sextant.llm import quality


def good(docs, labels):
    """Ids and texts that the classifier keeps, from both fits by plain gradient steps."""
    from test_quality import plain_fit

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {i: quality.features([(t or "").encode()])[0].astype(np.float32).astype(float) for i, t in texts.items()}
    usable = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    positive, unlabelled = (np.stack([x[i] for i in usable if label.get(i) == y]) for y in (1, None))

    def scores(prior, rows):
        model, w = plain_fit(positive, unlabelled, prior)
        return 1 / (1 + np.exp(-(model.design(rows) @ w[:-1] + w[-1])))

    p, u = (np.floor(scores(0.5, rows) * 1000) for rows in (positive, unlabelled))
    shares = [((u >= t).mean(), (p >= t).mean()) for t in range(1000)]
    prior = min(a / b for a, b in shares if b >= quality.POSITIVES)
    chance = dict(zip(x, scores(prior, np.stack(list(x.values()))), strict=True))
    return [(i, t) for i, t in texts.items() if chance[i] >= 0.3]


def test_pipeline_against_brute_force(spark, sf_small):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    from test_decontaminate import all_starts
    from test_line_dedup import brute as lines_of

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = good(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    left = lines_of(rows)
    rows = sorted((i, left[i]) for i, t in rows if left[i] == t or (left[i] or "").strip(" \t\n\r\x0b\x0c"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in ((i, words(t)) for i, t in rows)}
    group = {i: i for i in sets}
    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and 5 * len(s & t) >= 4 * len(s | t):
                a, b = sorted((group[i], group[j]))
                group = {x: a if g == b else g for x, g in group.items()}
    rows = [(i, t) for i, t in rows if group[i] == i]
    items = [(set(zip(*(w[j:] for j in range(5)), strict=False)), t) for t in (r["text"] for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()) for w in [words(t)]]
    leak = lambda i, t: any(s & sets[i] and all_starts(t or "", item) for s, item in items)
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, codec.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in rows if not leak(i, t)}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns


def test_copies_by_five_words(spark):
    """Near copies of 5 to 13 % other words, in a block or scattered, against brute force over five-word shingles at 0.8."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(6))
    rows = []
    for block, edits in ((60, 0), (80, 0), (100, 0), (130, 0), (0, 18), (0, 22), (0, 26)):
        one = [word() for _ in range(1000)]
        two = [word() for _ in range(block)] + one[block:]
        for i in r.sample(range(5, 995), edits):
            two[i] = word()
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i for i in shingles if not any(5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j]) for j in range(i))}
    assert {1, 3, 5, 9} & want == set() and {7, 13} <= want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.copies_stage(spark, docs, "").collect()} == want


def test_rows_that_repeat_an_id(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, words("t"), "a"), (2, words("t"), "b"), (2, words("other"), "c"), (3, words("u"), "d"), (3, words("u"), "d"), (None, words("t"), "e"), (None, words("t"), "f"), (4, None, "g"), (5, "", "h"), (5, "", "h"), (6, " \n", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    got = [(str(r["doc_id"]), r["text"], r["d"]) for r in corpus_pipeline.copies_stage(spark, docs, "").collect()]
    want = [("1", rows[0][1], "a"), ("2", rows[2][1], "c"), ("3", rows[3][1], "d"), ("4", None, "g"), ("5", "", "h"), ("6", " \n", "i"), ("None", rows[0][1], "e"), ("None", rows[0][1], "f")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_odd_tables(spark, sf_small, tmp_path):
    """Nulls, empties, a very long text, repeated rows, clashing names, and empty tables, through every stage."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    rows = [(1, None, 1, 2, 3), (2, "", 1, 2, 3), (None, "some text here", 1, 2, 3), (3, long, 1, 2, 3), (3, long, 1, 2, 3), (3, "a\na\nb c d", 1, 2, 3), (4, "\n\n", 1, 2, 3)]
    schema = "doc_id long, text string, score int, kept int, th int"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{docs.columns[0]}-{len(rows)}-{id(docs)}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{docs.columns[0]}-{len(rows)}-{id(docs)}-{i}")
            assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.count() == 0
