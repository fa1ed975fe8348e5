"""Packing a version's nodes into overlapping chunks with the place of each node in the text.

Sequential within a version (what is kept for the next chunk depends on what was packed), parallel
across versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_hash
from ..schemas import NODE_REF

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Sizes:
    """In words."""

    target: int = 450
    least: int = 200
    most: int = 650
    overlap: int = 80


def count(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Unit:
    node_id: str
    path: str | None
    heading: str | None
    text: str

    @cached_property
    def words(self) -> int:
        return count(self.text)


def _fitting(text: str, budget: int) -> Iterator[str]:
    """Paragraphs, or the sentences of those too long, or slices of those still too long."""
    blocks = text.split("\n\n" if "\n\n" in text else "\n")
    for paragraph in filter(None, map(str.strip, blocks)):
        if count(paragraph) <= budget:
            yield paragraph
            continue
        for sentence in filter(None, map(str.strip, SENTENCE_END.split(paragraph))):
            words = sentence.split()
            if len(words) <= budget:
                yield sentence
            else:
                yield from (" ".join(words[i : i + budget]) for i in range(0, len(words), budget))


def split_segment(segment: str, sizes: Sizes) -> list[str]:
    """The segment whole if it is short enough, else parts near the target, each under its first line."""
    segment = segment.strip()
    if not segment:
        return []
    if count(segment) <= min(sizes.most, max(2 * sizes.target, sizes.least)):
        return [segment]
    head, line_end, body = segment.partition("\n")
    head, body = (head.strip(), body.strip()) if line_end else ("", segment)
    budget = max(50, min(sizes.most, max(sizes.target, sizes.least, 1)) - count(head))
    parts: list[list[str]] = []
    room = 0
    for piece in _fitting(body, budget):
        n = count(piece)
        if not parts or n > room:
            parts.append([])
            room = budget
        parts[-1].append(piece)
        room -= n
    return ["\n".join(filter(None, [head, *p])) for p in parts]


@dataclass
class Packer:
    """Units go in one by one; chunks come out when they are full."""

    pipeline_version: str
    sizes: Sizes
    units: list[Unit] = field(default_factory=list)
    words: int = 0
    fresh: bool = False
    carried: list[Unit] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)
    chunks: list[dict] = field(default_factory=list)

    def start(self) -> None:
        """A new chunk begins with what the last one handed on, only once a real unit follows."""
        if not self.units:
            self.units, self.carried = self.carried, []
            self.words = sum(u.words for u in self.units)

    def add(self, unit: Unit) -> None:
        self.start()
        if self.units and self.words + unit.words > self.sizes.most and self.words >= self.sizes.least:
            self.close()
            self.start()
        self.units.append(unit)
        self.words += unit.words
        self.fresh = True
        if self.words >= max(self.sizes.target, self.sizes.least):
            self.close()

    def tail(self) -> list[Unit]:
        """Last units up to the overlap; none if one of them alone exceeds it."""
        chosen: list[Unit] = []
        total = 0
        for unit in reversed(self.units):
            if self.sizes.overlap <= 0 or unit.words > self.sizes.overlap:
                return []
            chosen.insert(0, unit)
            total += unit.words
            if total >= self.sizes.overlap:
                break
        return chosen

    def close(self) -> None:
        """Emit the chunk, unless all of it was handed on or an equal one was emitted."""
        units, fresh = self.units, self.fresh
        text = "\n\n".join(u.text for u in units)
        digest = chunk_hash(self.pipeline_version, text)
        self.carried = []
        if units and fresh and digest not in self.seen:
            self.seen.add(digest)
            self.carried = self.tail()
            refs, at = [], 0
            for u in units:
                refs.append({"node_id": u.node_id, "path": u.path, "heading": u.heading, "char_start": at, "char_end": at + len(u.text)})
                at += len(u.text) + 2
            self.chunks.append({"chunk_index": len(self.chunks), "chunk_hash": digest, "text": text, "node_refs": refs, "tokens_count": count(text)})
        self.units, self.words, self.fresh = [], 0, False


def build_chunks(nodes: list[dict], pipeline_version: str, sizes: Sizes = Sizes()) -> list[dict]:
    """Chunks of nodes (node_id, path, heading_text, text) in order."""
    packer = Packer(pipeline_version, sizes)
    for n in nodes:
        heading, text = ((n.get(k) or "").strip() for k in ("heading_text", "text"))
        for part in split_segment("\n".join(filter(None, (heading, text))), sizes):
            packer.add(Unit(str(n["node_id"]), n.get("path"), n.get("heading_text"), part.strip()))
    if packer.units:
        packer.close()
    return packer.chunks


CHUNK = f"version_id string, pipeline_version string, chunk_index int, chunk_hash string, text string, node_refs array<{NODE_REF}>, tokens_count int"


def chunks_of(nodes: DataFrame, pipeline_version: str, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of every version of nodes, with deterministic ids. A task holds the nodes of one version at a time."""
    names = ("chunk_index", "chunk_hash", "text", "node_refs", "tokens_count")
    refs = pa.list_(pa.struct([(n, pa.string()) for n in ("node_id", "path", "heading")] + [(n, pa.int32()) for n in ("char_start", "char_end")]))
    kinds = (pa.int32(), pa.string(), pa.string(), refs, pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = [pa.array([v for v, _ in out], pa.string()), pa.array([pipeline_version] * len(out), pa.string()), *(pa.array([c[n] for _, c in out], k) for n, k in zip(names, kinds, strict=True))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["version_id", "pipeline_version", *names])

        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["version_id"] != version:
                    out += [(version, c) for c in build_chunks(rows, pipeline_version, sizes)]
                    rows = []
                version = row["version_id"]
                rows.append(row)
            if len(out) > 256:
                yield made()
        if rows:
            out += [(version, c) for c in build_chunks(rows, pipeline_version, sizes)]
        if out:
            yield made()

    ordered = nodes.select("version_id", "node_id", "node_index", "path", "heading_text", F.col("text_normalized").alias("text")).repartition("version_id").sortWithinPartitions("version_id", "node_index")
    return ordered.mapInArrow(run, CHUNK).withColumn("chunk_id", F.sha2(F.concat_ws("|", "version_id", "pipeline_version", "chunk_hash"), 256))


#: Sizes under which a version of any length is one chunk.
WHOLE = Sizes(target=2**31 - 1, most=2**31 - 1)


class _ChunkNodes:
    """Chunks of the nodes of one version, which come in order; whole: one chunk, however long the version is."""

    def __init__(self):
        self.version, self.pipeline, self.sizes, self.rows = None, "", Sizes(), []

    def eval(self, pipeline_version: str, node, whole: bool = False):
        self.version, self.pipeline, self.sizes = node["version_id"], pipeline_version, WHOLE if whole else Sizes()
        self.rows.append({"node_id": node["node_id"], "path": node["path"], "heading_text": node["heading_text"], "text": node["text_normalized"]})

    def terminate(self):
        for c in build_chunks(self.rows, self.pipeline, self.sizes):
            yield self.version, self.pipeline, c["chunk_index"], c["chunk_hash"], c["text"], c["node_refs"], c["tokens_count"]


def register(spark: SparkSession) -> None:
    """Make chunking a table function: SELECT * FROM chunk_nodes('p1', TABLE(nodes) PARTITION BY version_id ORDER BY node_index).
    A third argument makes each version one chunk: ORDER BY (node_index), true."""
    spark.udtf.register("chunk_nodes", F.udtf(_ChunkNodes, returnType=CHUNK))
