"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count
ratios.

Texts are folded (A-Z as a-z, white space as one character) and give the hashed n-grams
of 3 to 6 bytes that occur in them, present or absent. The labelled rows that may be
learned from give each n-gram's naive Bayes log-count ratio; the COLUMNS n-grams that
tell the classes apart best, scaled by their ratios, feed a ridge logistic regression.
The fit sees at most SAMPLE labelled documents, half of each class where there are
enough, and its intercept is set back to the classes' shares among all labelled rows.
Every document is scored, over its whole text.

Learned from: rows of `labels` whose crc32(doc_id as text) mod 5 is not 0. doc_id, lang,
source and labels are never inputs of a score.

Edge cases: null and empty texts have no n-grams and score by the intercept alone. Rows
of `labels` with a null doc_id or label are left out; a doc_id labelled twice counts as
toxic if one row says so. Without labelled rows of both classes every score is the share
of label 1 (0 without labels). A null doc_id counts as held out. Repeated rows score
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import documents, durable, in_parts, utf8
from plumbline.llm.ngrams import BITS, fit_logistic, hashed_ngrams, present, sigmoid, slabs

SAMPLE = 12_000
COLUMNS = 1024
RIDGE = 1e-4
SMOOTHING = 1.0
FOLDS = 5


@dataclass(frozen=True)
class NgramModel:
    """column: of each hashed n-gram, or -1; weights of the columns; intercept."""

    column: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = np.zeros(len(texts))
        for at, part, ends in slabs(data, offsets):
            hits = present(part, ends, self.column, len(self.weights))
            # summed a row at a time: equal texts score equally wherever they stand
            out[at : at + len(hits)] = [self.weights[np.flatnonzero(h)].sum() for h in hits]
        return sigmoid(out + self.intercept)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label: one row per document that may be learned from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """doc_id, label, text of at most `most` labelled documents, an equal number of each class
    where there are enough. The choice follows a hash of the doc_id; it is at most `most` rows
    of 12 bytes, which bounds the broadcast. Of rows that repeat a doc_id one counts."""
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = rows.where("label = 1").orderBy(order, "doc_id").limit(most // 2).unionAll(rows.where("label = 0").orderBy(order, "doc_id").limit(most // 2))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return durable(one_of_each(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")), ["doc_id", "label"], ["text"]), "labelled")


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for all with the same keys: that of the least text by its hash. Each task sends
    one row a key at most, so a key that many rows share isn't gathered."""
    least = F.min(F.struct(F.xxhash64("text").alias("_mark"), *columns)).alias("_m")
    return rows.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])


def class_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """2 x buckets: documents of each class that have the n-gram; documents of each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in in_parts(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column("text"))
            for k in range(len(label)):
                flags = np.zeros(1 << BITS, bool)
                for _, bucket in hashed_ngrams(data[offsets[k] : offsets[k + 1]]):
                    flags[bucket] = True
                counts[label[k]] += flags
                docs[label[k]] += 1
        seen = np.flatnonzero(counts.any(0))
        ids = np.concatenate([seen, [-1]])
        both = np.concatenate([counts[:, seen], docs[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[0]), pa.array(both[1])], ["bucket", "n0", "n1"])

    partial = texts.select("label", "text").mapInArrow(rows, "bucket long, n0 long, n1 long")
    found = partial.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for name, c in (("n0", 0), ("n1", 1)):
        counts[c, found.bucket[found.bucket >= 0]] = found[name][found.bucket >= 0]
        docs[c] = found[name][found.bucket < 0].sum()
    return counts, docs


def select_ngrams(counts: np.ndarray, docs: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best by the difference of their shares, and
    the log-count ratios of naive Bayes."""
    share = counts / docs[:, None]
    pooled = counts.sum(0) / docs.sum()
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / docs[0] + 1 / docs[1]))
    z[counts.sum(0) < 3] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:columns])
    smooth = counts + SMOOTHING
    ratio = np.log(smooth[1] / (docs[1] + 2 * SMOOTHING)) - np.log(smooth[0] / (docs[0] + 2 * SMOOTHING))
    return best, ratio[best]


def feature_rows(texts: DataFrame, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix and labels of the sampled documents, in the order of doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            bits = [np.packbits(h).tobytes() for _, part, ends in slabs(data, offsets) for h in present(part, ends, column, columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bits, pa.binary())], ["doc_id", "label", "bits"])

    got = texts.select("doc_id", "label", "text").mapInArrow(rows, "doc_id long, label int, bits binary").toPandas().sort_values(["doc_id", "bits"])
    packed = np.frombuffer(b"".join(got.bits), np.uint8).reshape(len(got), -(-columns // 8))
    return np.unpackbits(packed, axis=1, count=columns).view(bool), got.label.to_numpy()


def scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """x * scale in single precision, without the whole in double precision on the way: it is the
    driver's largest array."""
    out = x.astype(np.float32)
    out *= scale.astype(np.float32)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, columns: int = COLUMNS) -> NgramModel:
    rows = labelled(labels, label)
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    all1, all0 = shares.get(1, 0), shares.get(0, 0)
    none = np.full(1 << BITS, -1, np.int16)
    texts = sample(docs, rows, most)
    counts, per_class = class_counts(texts)
    if not per_class.all():
        share = min(max(all1 / max(all1 + all0, 1), 1e-12), 1 - 1e-12)
        return NgramModel(none, np.zeros(1), float(np.log(share / (1 - share))))
    best, ratio = select_ngrams(counts, per_class, columns)
    column = none.copy()
    column[best] = np.arange(len(best))
    x, y = feature_rows(texts, column, len(best))
    scale = ratio / max(np.abs(ratio).max(), 1e-9)
    w, b = fit_logistic(scaled(x, scale), y, np.ones(len(y)), RIDGE)
    b += np.log(all1 / all0) - np.log(per_class[1] / per_class[0])
    return NgramModel(column, w.astype(np.float64) * scale, float(b))


def score_documents(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, score of every row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, columns as they are."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in in_parts(batches):
            yield batch.filter(pa.array(model.score(batch.column(at)) < 0.5))

    names = docs.columns
    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
