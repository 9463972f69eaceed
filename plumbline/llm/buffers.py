"""Small helpers that the training-data operators share: Arrow text buffers and rolling
hashes of byte strings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.components import discard, durable, shared_dir

__all__ = ["BLOCK", "byte_table", "discard", "documents", "durable", "fresh", "gear_hash", "marked_possible", "mix64", "in_parts", "shared_dir", "small_batches", "utf8", "without"]

BLOCK = 1 << 21
SIEVE_BITS = 1 << 23


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is executed inside: for rows of tens of
    kilobytes, of which the usual ten thousand don't fit an executor's memory. This sets the
    session's own value meanwhile: jobs that other threads start in it see it, too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def marked_possible(df: DataFrame, keys: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """df with a boolean column `flag`, true for every row whose values of `columns` are among
    keys and for few others. The keys make a bitmap of SIEVE_BITS (a megabyte, whatever their
    number), so wide rows that no key means needn't be shuffled to find that out."""
    place = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
    bucket, bits, at = fresh(df, "bucket", "bits", "at")
    bitmap = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits))
    rows = df.withColumn(at, place).withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(at, F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, int({at} div 8) + 1, 1)")), 16, 10).cast("int")
    found = F.expr(f"shiftleft(1, int({at} % 8))").bitwiseAND(byte) != 0
    return rows.join(F.broadcast(bitmap), bucket, "left").withColumn(flag, F.coalesce(found, F.lit(False))).select(*df.columns, flag)


def without(docs: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """docs without the rows that gone (doc_id, mark) names; mark: what it has of a text. Only
    rows that may be meant are shuffled."""
    own_id, own_mark, gone_id, gone_mark, flag = fresh(docs, "doc_id", "mark", "gone_id", "gone_mark", "flag")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(own_id), mark.alias(own_mark))
    keyed = marked_possible(keyed, gone.toDF(own_id, own_mark), [own_id, own_mark], flag)
    gone = gone.toDF(gone_id, gone_mark)
    meant = F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_mark) == F.col(gone_mark))
    kept = keyed.where(flag).join(gone, meant, "left_anti").select(docs.columns)
    return kept.unionAll(keyed.where(~F.col(flag)).select(docs.columns))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that what is made of a part stays small;
    at the end Arrow's unused memory goes back to the machine."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Row i is
    bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gear_hash(data: np.ndarray, table: np.ndarray, doublings: int) -> np.ndarray:
    """Rolling hash that ends at each byte over the 2**doublings bytes up to it;
    computed by doubling, so it costs log2(window) passes."""
    h = table[data]
    for k in range(doublings):
        step = 1 << k
        older = np.zeros_like(h)
        older[step:] = h[:-step] if step < len(h) else h[:0]
        h = h + (older << h.dtype.type(step))
    return h
