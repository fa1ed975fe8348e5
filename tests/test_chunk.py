from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.operators.chunk import Sizes, build_chunks, split_segment


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def node(i, text, heading=""):
    return {"node_id": str(i), "path": f"p{i}", "heading_text": heading, "text": text}


def test_long_segment_is_cut_under_its_heading():
    parts = split_segment("Head\n" + words(1000), Sizes())
    assert [p.split("\n")[0] for p in parts] == ["Head"] * 3 and [len(p.split()) for p in parts] == [450, 450, 103]
    assert split_segment(words(650), Sizes()) == [words(650)]
    sentences = ". ".join(words(60, c) for c in "abcdefghijkl") + "."
    assert all(len(p.split()) <= 450 for p in split_segment("H\n" + sentences, Sizes()))


def test_chunk_may_pass_the_most_words():
    got = build_chunks([node(1, words(199, "a")), node(2, words(650, "b"))], "v")
    assert [c["tokens_count"] for c in got] == [849]


def test_overlap_and_its_loss():
    small = [node(i, words(50, f"n{i}_")) for i in range(12)]
    got = build_chunks(small, "v")
    assert [c["tokens_count"] for c in got] == [450, 250]
    assert [r["node_id"] for r in got[1]["node_refs"]] == ["7", "8", "9", "10", "11"]
    big = build_chunks([node(1, words(400, "a")), node(2, words(100, "b")), node(3, words(50, "c"))], "v")
    assert [r["node_id"] for r in big[1]["node_refs"]] == ["3"]


def test_repeated_text_is_dropped():
    got = build_chunks([node(1, words(460)), node(2, words(460))], "v")
    assert len(got) == 1 and got[0]["chunk_index"] == 0


def test_nothing_comes_of_blank_nodes():
    assert build_chunks([], "v") == [] == build_chunks([node(1, " \n ", "")], "v")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=12))
def test_offsets_and_hashes(sizes):
    got = build_chunks([node(i, words(n, f"k{i}_"), f"H{i}") for i, n in enumerate(sizes)], "v")
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    assert len({c["chunk_hash"] for c in got}) == len(got)
    for c in got:
        assert "\n\n".join(c["text"][r["char_start"] : r["char_end"]] for r in c["node_refs"]) == c["text"]


def brute_parts(text, budget, most=650):
    """Cut by scanning: paragraphs, their sentences, their words; then as much as fits into each part."""
    if len(text.split()) <= most:
        return [text.strip()] if text.strip() else []
    head, _, body = text.strip().partition("\n")
    if not _:
        head, body = "", head
    budget = max(50, budget - len(head.split()))
    paragraphs = [p.strip() for p in body.strip().split("\n\n" if "\n\n" in body.strip() else "\n") if p.strip()]
    pieces = []
    for p in paragraphs:
        if len(p.split()) <= budget:
            pieces.append(p)
            continue
        sentence = ""
        for i, c in enumerate(p + " "):
            if c.isspace() and sentence.rstrip() == sentence and sentence[-1:] in (".", "!", "?"):
                pieces.append(sentence)
                sentence = ""
            sentence = (sentence + c) if sentence or not c.isspace() else ""
        if sentence.strip():
            pieces.append(sentence.strip())
    cut = []
    for piece in pieces:
        words = piece.split()
        cut += [piece] if len(words) <= budget else [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]
    parts = []
    while cut:
        n = 1
        while n < len(cut) and sum(len(x.split()) for x in cut[: n + 1]) <= budget:
            n += 1
        parts.append("\n".join(([head.strip()] if head.strip() else []) + cut[:n]))
        cut = cut[n:]
    return parts


def test_every_document_as_brute_force(spark, sf_small):
    """The registered query: all documents cut and packed, against cutting by scanning; each text alone is a version."""
    from sextant.functions.text import chunk_form, sha256
    from sextant.plans import queries

    want = set()
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        chunks, held, seen = [], [], set()

        def close(own):
            text = "\n\n".join(own)
            digest = sha256(f"v1|{chunk_form(text)}")
            if digest in seen:  # noqa: B023
                return []
            seen.add(digest)  # noqa: B023
            chunks.append((len(chunks), len(text.split()), len(own), digest))  # noqa: B023
            back, total = [], 0
            for u in reversed(own):
                if len(u.split()) > 80:
                    return []
                back, total = [u, *back], total + len(u.split())
                if total >= 80:
                    break
            return back

        fresh = False
        size = lambda x: sum(len(u.split()) for u in x)
        for unit in brute_parts(r["text"] or "", 450):
            if size(held) + len(unit.split()) > 650 and size(held) >= 200 and fresh:
                held, fresh = close(held), False
            held, fresh = [*held, unit], True
            if size(held) >= 450:
                held, fresh = close(held), False
        if held and fresh:
            close(held)
        want |= {(str(r["doc_id"]), *c) for c in chunks}
    got = {(r["version_id"], r["chunk_index"], r["tokens_count"], r["n_refs"], r["chunk_hash"]) for r in queries.chunks(spark, sf_small).collect()}
    assert len(got) > 200 and got == want
