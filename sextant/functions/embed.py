"""Embeddings behind a provider: role prefixes, batches, unit length.

A provider maps a list of texts to vectors. hashed() is a deterministic bag of words that needs no
model; a real model is a provider of the caller's, loaded once a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .text import strip_accents

Provider = Callable[[list[str]], np.ndarray]
PREFIX = {"query": "query: ", "passage": "passage: "}
BATCH = 32


def model_name(model_id: str) -> str:
    """The name before a revision: name@revision."""
    return model_id.split("@", 1)[0]


def hashed(dimension: int = 64) -> Provider:
    """Signed counts of hashed words."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for word in strip_accents(text.lower()).split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimension] += 1 if h >> 63 else -1
        return out

    return run


def embed(texts: list[str], provider: Provider, role: str, batch: int = BATCH) -> list[list[float]]:
    """Unit vectors of texts under the prefix of their role; a zero vector stays zero."""
    if role not in PREFIX:
        raise ValueError(f"role must be one of {sorted(PREFIX)}, not {role!r}")
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        v = np.asarray(provider([PREFIX[role] + (t or "") for t in texts[i : i + batch]]), float)
        out += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
    return out


@lru_cache(4)
def provider_of(make: Callable[[], Provider]) -> Provider:
    """The provider that make builds, kept for the next batch: a worker holds four at most."""
    return make()


def embedded(chunks: DataFrame, make: Callable[[], Provider], model_id: str, text: str = "text") -> DataFrame:
    """chunks with embedding and embedding_model_id; make builds the provider once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = provider_of(make)
        for batch in batches:
            yield pd.Series(embed(batch.tolist(), provider, "passage"))

    return chunks.withColumns({"embedding": run(F.col(text)), "embedding_model_id": F.lit(model_id)})


def embedded_once(chunks: DataFrame, known: DataFrame, make: Callable[[], Provider], model_id: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """chunks with embedding and embedding_model_id, and the vectors that were not known before (content_hash, embedding_model_id, embedding).

    known: vectors by content and model. A text that is known, or that several chunks have, is embedded once in all; what is
    left is embedded in the order of its length, so that a batch's texts are alike. The second table is written before it is
    joined, so the provider is asked once for each text.
    """
    hashed_text = chunks.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    known = known.where(F.col("embedding_model_id") == model_id).select("content_hash", "embedding_model_id", "embedding")
    # a text leaves each task once, however many chunks have it
    fresh = hashed_text.groupBy("content_hash").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("text")).join(known, "content_hash", "left_anti")
    fresh = fresh.repartition("content_hash").sortWithinPartitions(F.length("text"), "content_hash")
    new = written(embedded(fresh, make, model_id).select("content_hash", "embedding_model_id", "embedding"), "vectors")
    # a content that a third of the chunks has is dealt to several tasks by the join (skew), its vector to each
    return hashed_text.join(known.unionByName(new), "content_hash", "left").drop("content_hash"), new
