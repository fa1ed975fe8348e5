"""Count-only unigram tokenisation (operator 4).

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; a Viterbi pass
over the characters carries only the best score and the number of pieces of that path. Ties go, as
in the unigram model of the tokenizers library, to the path found first there: edges are relaxed by
start, so the earliest start (the longest last piece) wins and only a higher score replaces it. A
character no piece covers costs the lowest score less 10; neighbouring ones are one unknown token,
or one token a byte where the vocabulary has byte pieces.

Spaces become the word mark, and one is put in front. Where no piece holds a mark after another
character, words with their leading marks are independent and are counted once per worker.
Null and empty texts count 0 tokens; rows that repeat an id are counted each; a text is read as a whole, so a
task's memory follows the longest one. Extra columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._runtime import prepare, replaced, with_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 64


class Counter:
    """pieces: (piece, score) pairs; byte_pieces: whether unknown text falls back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.pieces, self.byte_pieces = pieces, byte_pieces
        self.ready()

    def ready(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in self.pieces}
        whole = all(float(s).is_integer() for _, s in self.pieces)  # sums of these are exact, so a prefix doesn't change ties
        split = whole and MARK in known and not any(MARK in p.lstrip(MARK) for p in known)
        self.units = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if split else lambda text: [text] if text else []
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return {"pieces": self.pieces, "byte_pieces": self.byte_pieces}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def viterbi(self, text: str) -> int:
        """Pieces of the best path over text."""
        n = len(text)
        unknown, byte_pieces = self.unknown, self.byte_pieces
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        pending = next(ends, None)
        single = [False] * n  # characters that are pieces themselves take no unknown edge
        found: list[tuple[int, float]] = []
        for end in range(n):
            found.clear()
            while pending is not None and pending[0] == end:
                found.append(pending[1])
                pending = next(ends, None)
            found.sort(reverse=True)  # longest first: the earliest start
            score, pieces, at = None, 0, False
            for length, s in found:
                start = end + 1 - length
                if length == 1:
                    single[end] = True
                if score is None or best[start] + s > score:
                    score, pieces, at = best[start] + s, count[start] + 1, False
            if not single[end] and (score is None or best[end] + unknown > score):
                score, at = best[end] + unknown, True
                if byte_pieces:
                    pieces = count[end] + len(text[end].encode())
                else:
                    pieces = count[end] + (not loose[end])
            best[end + 1], count[end + 1], loose[end + 1] = score, pieces, at
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, cache = 0, self.cache
        for unit in self.units(MARK + text.replace(" ", MARK)):
            pieces = cache.get(unit)
            if pieces is None:
                pieces = self.viterbi(unit)
                if len(unit) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[unit] = pieces
            total += pieces
        return total


def read_pieces(path: str) -> Counter:
    """A sentencepiece vocabulary: its normal pieces with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids))


_counters: dict[str, Counter] = {}


def public_counter(name: str = "piece_bpe_32k.model") -> Counter:
    import public_tokenizers

    path = public_tokenizers.path(name)
    if path not in _counters:
        _counters[path] = read_pieces(path)
    return _counters[path]


def count_tokens(df: DataFrame, counter: Counter, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(counter)  # its size is that of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield replaced(batch, {n_tokens: pa.array([own.count(t) for t in batch.column(text).to_pylist()], pa.int64())})

    return df.mapInArrow(run, with_columns(df.schema, [(n_tokens, T.LongType())]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_counter()).drop("text")
