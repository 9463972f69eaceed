"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of the last 16 bytes hits a pattern, so equal
passages are cut alike wherever they stand. Chunks are deduplicated to 128-bit
identifiers, which are verified: the chunk store is grouped by identifier *and* bytes,
and an identifier that stands for two byte strings makes the whole naming start again
with another seed. From then on a text is its recipe, the ordered list of its chunks'
identifiers, and only recipes are moved and compared; a long text crosses the network
once, as chunks, and repeated chunks are merged before they are sent.

Edge cases: a null text counts as empty; the empty text has the empty recipe, so all
empty texts are equal. Rows that repeat a doc_id are rows of their own and count in
group_size; those with the largest doc_id of their group are all marked kept. A null
doc_id never stays if another row of its group has one. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import BLOCK, byte_table, documents, durable, gear_hash, in_parts, utf8, without

WINDOW_DOUBLINGS = 4
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
HEAVY = 1000
SEEDS = 8

RECIPE_SCHEMA = "doc_id long, n_bytes long, text_sha256 string, recipe binary"
CHUNK_SCHEMA = "chunk_id binary, chunk binary"


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut, ascending."""
    table = byte_table(11).astype(np.uint32)
    width = 1 << WINDOW_DOUBLINGS
    mask = np.uint32(((1 << MEAN_BITS) - 1) << width)
    found = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, width - 1)
        h = gear_hash(data[at - lead : at + BLOCK], table, WINDOW_DOUBLINGS)[lead:]
        found.append(np.flatnonzero((h & mask) == 0) + (at + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_spans(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the chunks of data[start:end]. A cut counts only if its window lies in
    the text, so that equal texts are cut alike."""
    width = 1 << WINDOW_DOUBLINGS
    spans, at = [], start
    lo, hi = np.searchsorted(cuts, (start + width, end))
    for cut in cuts[lo:hi].tolist():
        while cut - at > MAX_CHUNK:
            spans.append((at, at + MAX_CHUNK))
            at += MAX_CHUNK
        if cut - at >= MIN_CHUNK:
            spans.append((at, cut))
            at = cut
    while end - at > MAX_CHUNK:
        spans.append((at, at + MAX_CHUNK))
        at += MAX_CHUNK
    if end > at:
        spans.append((at, end))
    return spans


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    data, offsets = utf8(batch.column("text"))
    cuts = cut_candidates(data)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[start:end].tobytes(), [(a - start, b - start) for a, b in chunk_spans(start, end, cuts)]


def _digest(chunk: bytes, seed: int, width: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)[:width]


def chunk_recipes(docs: DataFrame, seed: int = 0, width: int = 16) -> DataFrame:
    """One row per row of docs: its recipe and the digest of its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = list(_chunked(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t, _ in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t, _ in texts], pa.string()),
                    pa.array([b"".join(_digest(t[a:b], seed, width) for a, b in spans) for t, spans in texts], pa.binary()),
                ],
                ["doc_id", "n_bytes", "text_sha256", "recipe"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, RECIPE_SCHEMA)


def chunk_store(docs: DataFrame, seed: int = 0, width: int = 16) -> DataFrame:
    """The distinct chunks with their identifiers and use counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, chunks, held = [], [], 0
            for t, spans in _chunked(batch):
                for a, b in spans:
                    chunks.append(t[a:b])
                    ids.append(_digest(chunks[-1], seed, width))
                    held += b - a
                if held > 4 * BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(chunks, pa.binary())], ["chunk_id", "chunk"])
                    ids, chunks, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(chunks, pa.binary())], ["chunk_id", "chunk"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, CHUNK_SCHEMA).groupBy("chunk_id", "chunk").agg(F.count(F.lit(1)).alias("uses"))


def verified_seed(docs: DataFrame, width: int = 16, seeds: int = SEEDS) -> int:
    """The first seed under which no identifier stands for two different chunks."""
    for seed in range(seeds):
        clashes = chunk_store(docs, seed, width).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1")
        if clashes.isEmpty():
            return seed
    raise ValueError(f"identifiers of {width} bytes clash under {seeds} seeds")


def exact_groups(docs: DataFrame, width: int = 16, seeds: int = SEEDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs."""
    recipes = durable(chunk_recipes(docs, verified_seed(docs, width, seeds), width), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # HEAVY groups at most hold that share of the rows each: they are broadcast, and no key of
    # the other join holds more.
    groups, count = durable(groups, "groups"), recipes.count()
    heavy = F.col("group_size") * HEAVY >= count
    first = recipes.join(F.broadcast(groups.where(heavy)), "recipe", "left")
    rest = first.where("group_size is null").drop("keep_id", "group_size").join(groups.where(~heavy), "recipe", "left")
    joined = first.where("group_size is not null").unionByName(rest)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def _sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the largest doc_id, and of
    rows that repeat both doc_id and text one."""
    marks = durable(exact_groups(docs).select("doc_id", F.col("text_sha256").alias("mark"), "kept", "group_size"), "verdicts")
    repeated = marks.where("kept and group_size > 1").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "mark")
    repeated = durable(repeated, "repeated")
    gone = durable(marks.where("not kept").select("doc_id", "mark").unionAll(repeated), "gone")
    kept = without(docs, gone, _sha256(F.col("text")))
    if repeated.isEmpty():
        return kept
    same = docs["doc_id"].cast("long").eqNullSafe(repeated["doc_id"]) & (_sha256(docs["text"]) == repeated["mark"])
    once = docs.join(repeated, same, "left_semi")
    return kept.unionAll(once.dropDuplicates(["doc_id", "text"]))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
