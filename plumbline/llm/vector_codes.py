"""Product codes of vectors: integer k-means per part, nearest entries by slice and intersect.

A vector's components go onto an integer grid and its parts are matched with the entries of one
codebook for each part position. For the nearest entry of a part, each dimension's entry
coordinates are kept sorted, and with them prefix masks: bit e of mask i is set when entry e is
among the first i. A radius around a part's coordinate selects a range of the sorted ones, whose
entries are the XOR of two prefix masks; the AND over all dimensions leaves the entries of the box
around the part. Distances are measured for those only. The nearest of them is exact once its
distance is within the radius, as every nearer entry would be in the box; until then the radius
grows to that distance, or doubles where the box was empty.

A round is one pass over the vectors with the codebooks (a few thousand integers whatever the
input); tasks send one row of sums for each entry. All arithmetic is on integers, so results don't
depend on how rows are dealt.

Edge cases: a vector that is null or holds null or non-finite components is left out, and so is
one with a component of 2**14 or more in size, whose squared distances don't fit a long. Vectors
of several lengths, or of one that the parts don't divide, count as followed by zeros. Rows that
repeat stay rows of their own; the first entries come from the smallest vec_ids (null last, ties
by components). Fewer vectors than entries make a smaller codebook; an empty table gives an empty
result. Null labels are one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import in_parts

GRID = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
WIDEST = 1 << 14


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def gridded(vectors: DataFrame, grid: int = GRID) -> DataFrame:
    """vec_id, label, grid (components as integers) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < WIDEST, F.lit(False)))
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * grid).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", cells.alias("grid"))


class Slices:
    """Sorted coordinates and prefix masks of one codebook (at most 64 entries)."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask has 64 bits")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        self.prefix[1:] = np.bitwise_or.accumulate(bits, axis=0)
        # an entry's distance to its nearest other one, in the middle of the entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        near = apart.min(axis=1)
        near = near[np.isfinite(near)]
        self.radius = max(1, int(np.sqrt(np.median(near)))) if len(near) else 1

    def boxed(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within radius of each point in every dimension."""
        found = np.full(len(points), ~np.uint64(0))
        for d in range(points.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], points[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[:, d], points[:, d] + radius, "right")
            found &= self.prefix[hi, d] ^ self.prefix[lo, d]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each point; ties to the lower entry."""
        entry, best = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        left, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        width = np.arange(len(self.entries), dtype=np.uint64)
        while len(left):
            masks = self.boxed(points[left], radius)
            row, at = np.nonzero((masks[:, None] >> width) & np.uint64(1))
            apart = ((points[left[row]] - self.entries[at]) ** 2).sum(axis=1)
            some, starts, counts = np.unique(row, return_index=True, return_counts=True)
            radius = radius * 2
            if len(some):
                least = np.minimum.reduceat(apart, starts)
                first = np.minimum.reduceat(np.where(apart == np.repeat(least, counts), at, len(width)), starts)
                entry[left[some]], best[left[some]] = first, least
                reach = np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
                exact = least <= (radius[some] // 2) ** 2
                radius[some] = reach
                open_ = np.ones(len(left), bool)
                open_[some[exact]] = False
                left, radius = left[open_], radius[open_]
        return entry, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists as rows of dims integers, with zeros at the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _sums(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each used entry of a task: slot (part * entries + entry), n, sums."""
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in in_parts(batches, 4096):
            points = _matrix(batch.column("grid"), parts * width)
            for p, s in enumerate(slices):
                own = points[:, p * width : (p + 1) * width]
                slot = s.nearest(own)[0] + p * entries
                n += np.bincount(slot, minlength=len(n))
                np.add.at(sums, slot, own)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    return run


def _codes(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        for batch in in_parts(batches, 4096):
            points = _matrix(batch.column("grid"), parts * width)
            code, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p, s in enumerate(slices):
                code[:, p], far = s.nearest(points[:, p * width : (p + 1) * width])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A matrix (entry, position within the part) for each part of the gridded vectors; empty
    if there are none."""
    first = [r["grid"] for r in vectors.select("vec_id", "grid").orderBy(F.col("vec_id").asc_nulls_last(), "grid").limit(entries).collect()]
    if not first:
        return []
    longest = vectors.agg(F.max(F.size("grid"))).first()[0]
    width = max(1, -(-longest // parts))
    start = np.zeros((len(first), parts * width), np.int64)
    for row, grid in zip(start, first, strict=True):
        row[: len(grid)] = grid
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select("grid").mapInArrow(_sums(books), "slot int, n long, sums array<long>")
        before = [book.copy() for book in books]
        for r in _divided(sums, width).collect():
            books[r["slot"] // len(first)][r["slot"] % len(first)] = r["means"]
        if all((b == a).all() for b, a in zip(before, books, strict=True)):
            break  # the remaining rounds change nothing
    return books


def _divided(sums: DataFrame, width: int) -> DataFrame:
    """slot, means: of at most one row for each entry of a codebook."""
    totals = sums.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(width)])
    means = [F.expr(f"(s{j} - pmod(s{j}, n)) div n") for j in range(width)]
    return totals.select("slot", F.array(*means).alias("means"))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of gridded vectors."""
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select("vec_id", "label", "grid").mapInArrow(_codes(books), schema)


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, grid: int = GRID) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256."""
    cells = gridded(vectors, grid)
    books = codebooks(cells, parts, entries, rounds)
    codes = coded(cells, books)
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector of `embeddings`: 8 parts, 16 entries a part, 6 rounds."""
    return product_codes(embeddings(spark, sf_dir))


def _oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, grid: int = GRID) -> str:
    """Parts as lists; each round's distances by list functions, its means by position."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {grid}) AS BIGINT)) AS g FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT vec_id, label, p, g[CAST(p * len(g) // {parts} + 1 AS BIGINT):CAST((p + 1) * len(g) // {parts} AS BIGINT)] AS x FROM kept, range({parts}) AS t(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min(row(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS best
          FROM cut JOIN book{r} USING (p) GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best[2] AS e, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
              FROM (SELECT p, best, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY p, best[2], i) GROUP BY p, e)""")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    return f"""WITH {', '.join(steps)},
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


ORACLE_SQL = _oracle_sql()
