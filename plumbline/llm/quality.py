"""Quality classifier by co-training of two views.

The text view sees which hashed character n-grams a text has; the metadata view sees its
language, source and layout (size, lines, shares of letters, digits, symbols, capitals and
white space), but no words. Each view has a logistic regression fitted on the labelled
sample. In each round both views score all unlabelled documents, and each labels those it is
surest of, in the classes' proportions, and hands them to the *other* view, which learns from
them at half weight. At the end both views are calibrated together on labelled documents that
neither was fitted on, and every document is scored over its whole text.

The views of unlabelled documents are made once and stored, COLUMNS bits and some forty numbers
a document, so a round reads no text; tasks send their surest ones. What a fit sees is bounded:
LABELLED labelled documents, chosen by a hash of the doc_id, and HANDED a round that the other
view is surest of among all. Rows of `labels` whose crc32(doc_id as text) mod 5 is 0 are held
out. Counts of classes are taken over all labelled rows.

Edge cases: null and empty texts have no n-grams and a layout of zeros. A null language or
source is a value of its own. Label rows with nulls are left out; a doc_id labelled twice
counts as good if one row says so. If a class is missing, every score is the share of
good labels (1 where there are no labels: without evidence nothing is rejected). Repeated
rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import BLOCK, discard, documents, durable, in_parts, utf8
from plumbline.llm.ngrams import BITS, fit_logistic, present, sigmoid, slabs
from plumbline.llm.toxicity import class_counts, held_out, labelled, one_of_each, select_ngrams

LABELLED = 8_000
HANDED = 400
COLUMNS = 512
ROUNDS = 4
SURE = 0.95
PSEUDO_WEIGHT = 0.5
RIDGE = 1e-3
LANGS, SOURCES, LAYOUT = 8, 16, 8


def _classes() -> np.ndarray:
    """0 lower or non-ASCII letter, 1 capital, 2 digit, 3 white space, 4 other, 5 later byte of a letter."""
    kind = np.full(256, 4, np.uint8)
    kind[97:123] = 0
    kind[192:] = 0
    kind[65:91] = 1
    kind[48:58] = 2
    kind[[9, 11, 12, 13, 32, 10]] = 3
    kind[128:192] = 5
    return kind


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x LAYOUT: what a page's outline tells without reading it."""
    n = len(offsets) - 1
    counts, lines = np.zeros((n, 6)), np.zeros(n)
    kinds = _classes()
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        row = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, at + len(part))))
        counts += np.bincount(row * 6 + kinds[part], minlength=6 * n).reshape(n, 6)
        lines += np.bincount(row[part == 10], minlength=n)
    chars = counts[:, :5].sum(1)
    share = counts[:, :5] / np.maximum(chars, 1)[:, None]
    return np.column_stack([np.log1p(chars), np.log1p(lines), np.log1p(chars / (lines + 1)), share]).astype(np.float32)


def metadata(data: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """The metadata view: layout, then one-hot buckets of language and source."""
    out = np.zeros((len(langs), LAYOUT + LANGS + SOURCES), np.float32)
    out[:, :LAYOUT] = layout(data, offsets)
    for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
        out[k, LAYOUT + zlib.crc32(repr(lang).encode()) % LANGS] = 1
        out[k, LAYOUT + LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    return out


@dataclass(frozen=True)
class TwoViews:
    """Fitted views. blend: weights of both logits and an intercept."""

    column: np.ndarray
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    centre: np.ndarray
    spread: np.ndarray
    blend: np.ndarray

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata and by both."""
        data, offsets = utf8(batch.column("text"))
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        t, m = np.zeros(len(langs)), np.zeros(len(langs))
        w = self.text[0].astype(np.float64)
        for at, part, ends in slabs(data, offsets):
            hits = present(part, ends, self.column, len(w))
            to = at + len(hits)
            # summed a row at a time: equal rows score equally wherever they stand
            t[at:to] = [w[np.flatnonzero(h)].sum() for h in hits]
            x = (metadata(part, ends, langs[at:to], sources[at:to]) - self.centre) / self.spread
            m[at:to] = (x * self.meta[0]).sum(1)
        t, m = t + self.text[1], m + self.meta[1]
        return sigmoid(t), sigmoid(m), sigmoid(self.blend[0] * t + self.blend[1] * m + self.blend[2])


VIEWS = "doc_id long, label int, bits binary, meta binary"
NAMES = ["doc_id", "label", "bits", "meta"]


def view_rows(rows: DataFrame, column: np.ndarray, columns: int) -> DataFrame:
    """doc_id, label, and both views (bits of the text view, float32 of the metadata view)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            bits = [np.packbits(h).tobytes() for _, part, ends in slabs(data, offsets) for h in present(part, ends, column, columns)]
            meta = metadata(data, offsets, batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(bits, pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], NAMES)

    return rows.select("doc_id", "label", "text", "lang", "source").mapInArrow(encode, VIEWS)


def _bits(column: list[bytes], columns: int) -> np.ndarray:
    return np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=columns) for b in column], np.float32).reshape(len(column), columns)


def _numbers(column: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float32) for b in column], np.float32).reshape(len(column), LAYOUT + LANGS + SOURCES)


@dataclass
class View:
    """What one view learns from: the labelled sample, and what the other view handed it."""

    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    handed: dict[int, tuple[np.ndarray, int]] = field(default_factory=dict)  # by doc_id

    def fitted(self) -> tuple[np.ndarray, float]:
        more = [x for x, _ in self.handed.values()]
        x = np.concatenate([self.x, np.array(more, np.float32).reshape(len(more), self.x.shape[1])])
        y = np.concatenate([self.y, [label for _, label in self.handed.values()]])
        return fit_logistic(x, y, np.concatenate([self.weight, np.full(len(more), PSEUDO_WEIGHT)]), RIDGE)


def surest(views: DataFrame, columns: int, models: dict, known: dict[str, set[int]], most: dict[int, int], centre: np.ndarray, spread: np.ndarray) -> list:
    """Rows teacher (the view that is sure), label, doc_id, sure, bits, meta: of all rows of views,
    the `most` of each label that either view is surest of, SURE at least, and that the other
    view hasn't got yet (known)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], dict[int, tuple]] = {(v, k): {} for v in models for k in most}
        for batch in in_parts(batches):
            ids, bits, meta = (batch.column(c).to_pylist() for c in ("doc_id", "bits", "meta"))
            for view, x in (("text", _bits(bits, columns)), ("meta", (_numbers(meta) - centre) / spread)):
                w, b = models[view]
                p = sigmoid((x * w).sum(axis=1, dtype=np.float64) + b)
                for label, sure in ((1, p), (0, 1 - p)):
                    kept = best[view, label]
                    for k in np.flatnonzero(sure >= SURE).tolist():
                        row = (-float(sure[k]), ids[k], bits[k], meta[k])
                        if ids[k] not in known[view] and (ids[k] not in kept or row < kept[ids[k]]):
                            kept[ids[k]] = row
                    if len(kept) > most[label]:
                        best[view, label] = {r[1]: r for r in sorted(kept.values())[: most[label]]}
        rows = [(v, k, r[1], -r[0], r[2], r[3]) for (v, k), kept in best.items() for r in kept.values()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["teacher", "label", "doc_id", "sure", "bits", "meta"])

    told = views.mapInArrow(scored, "teacher string, label int, doc_id long, sure double, bits binary, meta binary")
    one = told.groupBy("teacher", "label", "doc_id").agg(F.max(F.struct("sure", "bits", "meta")).alias("m")).select("teacher", "label", "doc_id", "m.*")
    one = durable(one, "surest")
    found = []
    for view in models:
        for label in most:
            own = one.where((F.col("teacher") == view) & (F.col("label") == label))
            found += own.orderBy(F.desc("sure"), "doc_id").limit(most[label]).collect()  # `most` rows
    discard(one)
    return found


def co_train(text: View, meta: View, views: DataFrame, centre: np.ndarray, spread: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED) -> tuple[tuple, tuple]:
    """Models of both views after `rounds` of exchanging their surest labels about views, the
    stored views of unlabelled documents."""
    own = {"text": text, "meta": meta}
    other = {"text": "meta", "meta": "text"}
    good = float((text.weight * text.y).sum() / text.weight.sum())
    most = {label: max(1, int(handed * share)) for label, share in ((1, good), (0, 1 - good))}
    for _ in range(rounds):
        models = {v: own[v].fitted() for v in own}
        known = {v: set(own[other[v]].handed) for v in own}
        told = surest(views, text.x.shape[1], models, known, most, centre, spread)
        for r in told:
            x = _bits([r["bits"]], text.x.shape[1])[0] if other[r["teacher"]] == "text" else ((_numbers([r["meta"]]) - centre) / spread)[0]
            own[other[r["teacher"]]].handed[r["doc_id"]] = (x, r["label"])
        if not told:
            break
    return text.fitted(), meta.fitted()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> TwoViews:
    rows = labelled(labels, label)
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    order = F.xxhash64("doc_id", F.lit(29))
    chosen = rows.where("label = 1").orderBy(order, "doc_id").limit(most // 2).unionAll(rows.where("label = 0").orderBy(order, "doc_id").limit(most // 2))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    # at most LABELLED rows of 12 bytes are broadcast
    picked = wanted.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "label")), F.col("doc_id") == F.col("_id"))
    sampled = durable(one_of_each(picked, ["doc_id", "label"], ["text", "lang", "source"]), "quality-sample")
    column = np.full(1 << BITS, -1, np.int16)
    counts, per_class = class_counts(sampled)
    if not per_class.all():
        share = n1 / (n1 + n0) if n1 + n0 else 1.0
        b = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
        width = LAYOUT + LANGS + SOURCES
        return TwoViews(column, (np.zeros(1), b), (np.zeros(width), b), np.zeros(width), np.ones(width), np.array([0.0, 0.0, b]))
    best, _ = select_ngrams(counts, per_class, COLUMNS)
    column[best] = np.arange(len(best))
    got = view_rows(sampled, column, len(best)).toPandas().sort_values("doc_id")
    y, xt, xm = got.label.to_numpy(), _bits(list(got.bits), len(best)), _numbers(list(got.meta))
    centre, spread = xm.mean(0), np.maximum(xm.std(0), 1e-3)
    xm = (xm - centre) / spread
    weight = np.where(y == 1, n1 / (n1 + n0) / per_class[1], n0 / (n1 + n0) / per_class[0]) * per_class.sum()
    seen = np.array([zlib.crc32(str(d).encode()) % 10 for d in got.doc_id])
    train, calibrate = seen >= 2, seen < 2
    views = view_rows(wanted.where("doc_id is not null").withColumn("label", F.lit(-1)), column, len(best))
    views = durable(views.join(rows.select("doc_id"), "doc_id", "left_anti"), "views")
    text, meta = co_train(*(View(x[train], y[train], weight[train]) for x in (xt, xm)), views, centre, spread)
    discard(views)
    logits = np.column_stack([xt @ text[0] + text[1], xm @ meta[0] + meta[1]])
    use = calibrate if len(set(y[calibrate])) == 2 else train
    scale = np.maximum(np.abs(logits[use]).max(0), 1.0)
    w, b = fit_logistic(logits[use] / scale, y[use], weight[use], 1e-4, 1000)
    return TwoViews(column, text, meta, centre, spread, np.array([w[0] / scale[0], w[1] / scale[1], b]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted of every row of docs."""
    model = fit(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, model.scores(batch))], ["doc_id", "text_score", "meta_score", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    scored = wanted.mapInArrow(rows, "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
