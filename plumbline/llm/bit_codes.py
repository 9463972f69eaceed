"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

A vector is scaled to length 1 and rotated by a random orthogonal matrix that a seed gives; the
signs of its components, packed into bits, are its code. Read as +-1 / sqrt(dims), the code is
itself a unit vector; `align` is its inner product with what it stands for. For a unit query q,
<code, q> / align estimates <vector, q> without bias, and its error stays within
confidence * sqrt((1 - align^2) / align^2 / (dims - 1)) but for a share of vectors that falls with
`confidence` as the tail of a normal distribution. Length, align and bits are all that the
estimates use.

The index is dealt into blocks of about `block` vectors by a hash, and each query meets each
block once: only queries are copied, once for every `block` vectors, and a task holds one block
and one batch of queries. Within a block, the exact inner products of the k best estimates give a
bound that the block's k-th best reaches; every vector whose upper error bound reaches it is
measured, in single precision first, and exactly if that leaves it among the k best; those go on. A query's blocks meet as k rows each.

Work is (queries) * (vectors) estimates: coarse cells wouldn't lessen it on vectors without
clusters (see README), so none are used and no vector is out of reach.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
shorter vectors count as followed by zeros. A query doesn't find rows of its own vec_id. Rows
that repeat a vec_id and vector are one query, and as candidates each of them counts. Rows without
vec_id are found, after equals that have one, and are no queries. Fewer candidates than k are all
returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.buffers import in_parts

K = 20
EVERY = 20
SEED = 13
CONFIDENCE = 3.0
BLOCK = 16_384
TOGETHER = 64  # queries that are estimated at once
RUN = 128  # values in a run, when the greatest are looked for
INDEX = "vec_id long, copies long, embedding array<double>, code binary, length double, align double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, copies: one row for all that repeat both."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where(F.col("embedding").isNotNull() & finite & some).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """The lists as rows of dims numbers, with zeros at the end."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths; components of any size don't overflow a square."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (most * length)[:, 0]


def one_bit_codes(vectors: DataFrame, dims: int, seed: int = SEED) -> DataFrame:
    """The usable vectors with code (packed bits), length and align."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims, seed)
        for batch in in_parts(batches, 4096):
            if not batch.num_rows:
                continue
            turned, length = unit(dense(batch.column("embedding"), dims))
            turned = turned @ turn
            bits = np.packbits(turned >= 0, axis=1)
            align = np.abs(turned).sum(axis=1) / np.sqrt(dims)
            code = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("vec_id", "copies", "embedding")), code, pa.array(length), pa.array(align)], ["vec_id", "copies", "embedding", "code", "length", "align"])

    return vectors.select("vec_id", "copies", "embedding").mapInArrow(encode, INDEX)


class Block:
    """The vectors of one block, ready for queries."""

    def __init__(self, batch: pa.RecordBatch, dims: int, confidence: float, seed: int):
        self.vectors = dense(batch.column("embedding"), dims)
        ids = batch.column("vec_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.copies = batch.column("copies").to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1, count=dims)
        align, length = batch.column("align").to_numpy(), batch.column("length").to_numpy()
        self.signs = (bits.astype(np.float32) * 2 - 1).T
        # single precision where no length is beyond it
        kind = np.float32 if 1e-15 < length.min() and length.max() < 1e15 else np.float64
        self.scale = (length / align / np.sqrt(dims)).astype(kind)
        self.slack = (length * (confidence * np.sqrt(np.maximum(0, 1 - align * align) / (align * align) / max(1, dims - 1)) + 1e-5)).astype(kind)
        self.turn, self.dims = rotation(dims, seed), dims
        self.single, self.length = unit(self.vectors)[0].T.astype(np.float32), length
        # twice what rounding the components and their sum can do to the product of unit vectors
        self.blur = length * (dims + 8) * 2.0**-23

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products in double precision, summed from the first component on."""
        return np.cumsum(self.vectors[at] * query, axis=1)[:, -1] if len(at) else np.zeros(0)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the block, scores) of each query's k best, best first. What the codes' bound lets
        through is measured in single precision, and what may be among the k best by that exactly."""
        units, length = unit(queries)
        estimates = ((units @ self.turn).astype(np.float32) @ self.signs) * self.scale
        nearly = units.astype(np.float32) @ self.single
        for query, own_id, about, single, size in zip(queries, own, estimates, nearly, length, strict=True):
            about[self.known & (self.ids == own_id)] = -np.inf
            at = greatest(about, k)
            at = at[about[at] > -np.inf]
            if not len(at):
                yield at, np.zeros(0)
                continue
            if len(at) == k:
                least = self.exact(query, at).min() / size
                passed = about + self.slack >= least
                score = np.where(passed, single * self.length, -np.inf)
                sure = greatest(score - self.blur, k)  # at least k pass, those that gave the bound
                at = np.flatnonzero(score + self.blur >= (score[sure] - self.blur[sure]).min())
            score = self.exact(query, at)
            first = np.lexsort((~self.known[at], self.ids[at], -score))[:k]
            yield at[first], score[first]


def greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values (all, if fewer). The k-th of the runs' greatest is no greater than
    the k-th of all, so only what reaches it is put in order."""
    if len(values) <= k:
        return np.arange(len(values))
    at = np.arange(len(values))
    if len(values) >= RUN * k:
        runs = np.maximum.reduceat(values, np.arange(0, len(values), RUN))
        at = np.flatnonzero(values >= np.partition(runs, len(runs) - k)[len(runs) - k])
    return at[np.argpartition(-values[at], k - 1)[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: of queries (vec_id, embedding) among vectors."""
    every, asked = usable(vectors), usable(queries.where("vec_id IS NOT NULL"))
    n, dims = every.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks, dims = max(1, -(-n // block)), dims or 1
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("length", "double"), ("align", "double"))]
    held = one_bit_codes(every, dims, seed).select("*", F.lit(None).cast("binary").alias("mark"), F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"))
    mark = F.unhex(F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").cast("binary"), 256))
    # marked before a query is copied for each block
    sent = asked.withColumn("mark", mark).select("vec_id", "copies", "embedding", *empty, "mark", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = held.unionByName(sent).repartitionById(blocks, "block").sortWithinPartitions("block", F.col("mark").isNotNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for batch in in_parts(batches, TOGETHER):
            asks = batch.column("mark").is_valid().to_numpy(zero_copy_only=False)
            if not asks.all():
                parts.append(batch.filter(pa.array(~asks)))
                batch = batch.filter(pa.array(asks))
            if not batch.num_rows:
                continue
            if now is None:
                now = Block(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], dims, confidence, seed) if parts else False
                parts = []
            if not now:
                continue
            ids = batch.column("vec_id").to_numpy()
            found = list(now.search(dense(batch.column("embedding"), dims), ids, k))
            each = [len(at) for at, _ in found]
            at, score = np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])
            rows = np.repeat(np.arange(len(ids)), each)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), batch.column("mark").take(pa.array(rows)), pa.array(now.ids[at], mask=~now.known[at]), pa.array(score), pa.array(now.copies[at])],
                ["query_id", "mark", "vec_id", "score", "copies"],
            )

    best = dealt.select("block", "vec_id", "copies", "embedding", "code", "length", "align", "mark").mapInArrow(search, "query_id long, mark binary, vec_id long, score double, copies long")
    best = best.select("query_id", "mark", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy")).drop("copy")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of `embeddings` whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}"""
