"""Removal of repeated passages by prefix-free parsing.

Every byte that a DEPTH-byte string covers which also starts earlier in the corpus (by
doc_id, then place) is removed; strings never cross documents and are judged on the input.

Texts are parsed at rolling-hash triggers (see phrases), so equal passages give equal
phrases. The dictionary holds the distinct phrases, the parse their places in the texts:

1. The parse travels in packed blocks, dealt by trigger, with the phrases' fingerprints. All
   but the first occurrence of a phrase are repeats as a whole; long repeats end here.
2. Where a trigger leads into different phrases, these are the dictionary: their texts are
   read again and dealt by trigger, each phrase once. A task builds the suffix array of its
   range of the dictionary by prefix doubling, to DEPTH bytes, and combines it with the
   parse: strings in alphabetical order, equal ones in the order of their phrases' places.
   That is the corpus order of these strings, as a phrase holds all DEPTH bytes that follow
   each of its strings. In a run of equal strings all but the first are repeats.
3. Triggers with very many phrases (a common line between ever different neighbours) would
   land in one task. A sample of the documents finds them; their strings are dealt one by
   one, by fingerprint, and each task sends the first of equal ones only. Which triggers
   are treated so changes the work, never the result.

Suffixes of phrases that are alone with their trigger can't equal others, so they are never
sorted, and no array over the whole corpus is built. Fingerprints have 80 bits or more.

Edge cases: null counts as empty; texts shorter than DEPTH lose nothing. Rows with a null
doc_id have no place in the order: they lose nothing and are no source. Rows that repeat a
doc_id are one document: equal places aren't earlier than each other, and what one of
the rows loses, all lose. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import documents, durable, in_parts, utf8
from plumbline.llm.ngrams import slabs
from plumbline.llm.phrases import DEPTH, Parser

BLOCK_PHRASES = 1 << 19
BUCKET_PHRASES = 1 << 20
BUCKET_BYTES = 1 << 21
PHRASE_BYTES = 32  # typical, to set the number of buckets
SAMPLE_STEP = 64
HOT_IN_SAMPLE = 64
HOT_MOST = 1 << 16
SPREAD = 16

BLOCKS = "grp int, docs binary, runs binary, head binary, mark binary, start binary, strings binary"
NAMES = ["grp", "docs", "runs", "head", "mark", "start", "strings"]
SPANS = "doc_id long, kind int, one int, two int"
COVER, REQUEST = 0, 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _six(mark: np.ndarray) -> bytes:
    """The low six bytes of each mark."""
    return mark.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _runs(doc: np.ndarray) -> tuple[bytes, bytes]:
    """Run-length form of a column of doc_ids."""
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    return doc[edge[:-1]].astype(np.int64).tobytes(), np.diff(edge).astype(np.int32).tobytes()


def _column(frame: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in frame[name]])


def _docs(frame: pd.DataFrame) -> np.ndarray:
    return np.repeat(_column(frame, "docs", np.int64), _column(frame, "runs", np.int32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], NAMES)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows in their order) of the buckets that have rows."""
    at = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[at], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b + 1] > ends[b]:
            yield b, at[ends[b] : ends[b + 1]]


def _spans(doc: np.ndarray, kind: int, one: np.ndarray, two: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc.astype(np.int64), "kind": np.int32(kind), "one": one.astype(np.int32), "two": two.astype(np.int32)})


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of pairs, and the pairs, of a column of lists of pairs; null has none."""
    values = column.flatten()
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), *(values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def united(one: np.ndarray, two: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [one, two) united where they meet within a group."""
    at = np.lexsort((one, group))
    one, two, group = one[at].astype(np.int64), two[at].astype(np.int64), group[at]
    if not len(one):
        return one, two, group
    shift = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * (int(two.max()) + 2)
    reach = np.maximum.accumulate(two + shift)
    new = np.concatenate([[True], (one + shift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(one)) - 1
    return one[first], reach[last] - shift[first], group[first]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    changed = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.concatenate([[True], changed])


def _later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows that lie after the first place of their run."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[first]) | (start != start[first])


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Parser, np.ndarray]]:
    """doc_ids, parser and offsets of each slab."""
    ids = batch.column("doc_id").to_numpy()
    data, offsets = utf8(batch.column("text"))
    for at, part, ends in slabs(data, offsets, 1 << 14):
        yield ids[at : at + len(ends) - 1], Parser(part, ends), ends


def hot_triggers(docs: DataFrame) -> np.ndarray:
    """Triggers that lead into many different phrases in a sample of the documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            for _, parser, _ in _parsed(batch):
                p = parser.phrases()
                yield pa.RecordBatch.from_arrays([pa.array(p.trigger.view(np.int64)), pa.array(p.mark.view(np.int64))], ["trigger", "mark"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE_STEP)) == 0)
    found = sample.mapInArrow(rows, "trigger long, mark long").distinct().groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases"))
    hot = found.where(F.col("phrases") >= HOT_IN_SAMPLE).orderBy(F.col("phrases").desc(), "trigger").limit(HOT_MOST)
    return np.sort(np.array([r["trigger"] for r in hot.collect()], np.int64).view(np.uint64))


def phrase_blocks(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of phrases (grp below buckets), of hot triggers' strings (the SPREAD groups per
    bucket above) and of places already known as repeats (as many groups above those)."""

    def flush(parts: list[tuple], hots: list[tuple], salt: int) -> pa.RecordBatch:
        rows, known = [], []
        if parts:
            doc, start, strings, trigger, mark = (np.concatenate(c) for c in zip(*parts, strict=True))
            at = np.lexsort((start, doc, mark, trigger))
            doc, start, strings, trigger, mark = doc[at], start[at], strings[at], trigger[at], mark[at]
            first = _new(mark, trigger)
            again = _later(first, doc, start)
            known.append((doc[again], start[again], start[again] + strings[again] - 1 + DEPTH))
            at = np.flatnonzero(first)
            at = at[np.lexsort((start[at], doc[at]))]
            doc, start, strings, trigger, mark = doc[at], start[at], strings[at], trigger[at], mark[at]
            for b, k in _by_bucket(((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets):
                rows.append((b, *_runs(doc[k]), trigger[k].astype(np.uint32).tobytes(), _six(mark[k]), start[k].astype(np.uint32).tobytes(), strings[k].astype(np.uint8).tobytes()))
        if hots:
            doc, start, mark = (np.concatenate(c) for c in zip(*hots, strict=True))
            at = np.lexsort((start, doc, mark))
            doc, start, mark = doc[at], start[at], mark[at]
            first = _new(mark)
            again = _later(first, doc, start)
            known.append((doc[again], start[again], start[again] + DEPTH))
            doc, start, mark = doc[first], start[first], mark[first]
            n = SPREAD * buckets
            for b, k in _by_bucket(((mark >> np.uint64(32)) % np.uint64(n)).astype(np.int64), n):
                k = k[np.argsort(doc[k], kind="stable")]
                rows.append((buckets + b, *_runs(doc[k]), None, mark[k].tobytes(), start[k].astype(np.uint32).tobytes(), None))
        one, two, doc = united(*(np.concatenate(c) for c in zip(*((s, e, d) for d, s, e in known), strict=True))) if known else (np.zeros(0),) * 3
        if len(doc):
            rows.append(((1 + SPREAD + salt % SPREAD) * buckets + salt // SPREAD % buckets, *_runs(doc), None, None, one.astype(np.uint32).tobytes(), two.astype(np.uint32).tobytes()))
        return _batch(rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hots, held, salt = [], [], 0, 0
        for batch in in_parts(batches):
            for ids, parser, ends in _parsed(batch):
                p = parser.phrases()
                doc = ids[p.row]
                common = hot[np.minimum(np.searchsorted(hot, p.trigger), len(hot) - 1)] == p.trigger if len(hot) else np.zeros(len(doc), bool)
                cold = ~common
                parts.append((doc[cold], p.start[cold], p.strings[cold], p.trigger[cold], p.mark[cold]))
                if common.any():
                    count = p.strings[common]
                    place, gram, mark = parser.strings(p.start[common] + ends[p.row[common]], count)
                    row = np.repeat(p.row[common], count)
                    hots.append((ids[row], place - ends[row], mark ^ (gram << np.uint64(1))))
                    held += int(count.sum())
                held += int(cold.sum())
                if held > BLOCK_PHRASES:
                    salt += int(doc[0]) if len(doc) else 1
                    yield flush(parts, hots, salt)
                    parts, hots, held = [], [], 0
        if parts:
            yield flush(parts, hots, salt)

    return docs.mapInArrow(rows, BLOCKS)


def repeats(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per document: places that repeat earlier ones (COVER: from, to) and phrases whose
    strings have to be compared (REQUEST: place, strings)."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        grp = int(frame["grp"].iloc[0])
        doc, start = _docs(frame), _column(frame, "start", np.uint32).astype(np.int64)
        if grp >= buckets + SPREAD * buckets:
            return _spans(doc, COVER, start, _column(frame, "strings", np.uint32).astype(np.int64))
        if grp >= buckets:
            mark = _column(frame, "mark", np.uint64)
            at = np.lexsort((start, doc, mark))
            again = at[_later(_new(mark[at]), doc[at], start[at])]
            one, two, doc = united(start[again], start[again] + DEPTH, doc[again])
            return _spans(doc, COVER, one, two)
        head, strings = _column(frame, "head", np.uint32), _column(frame, "strings", np.uint8).astype(np.int64)
        mark = np.concatenate([_unsix(x) for x in frame["mark"]])
        at = np.lexsort((start, doc, mark, head))
        doc, start, head, strings, mark = doc[at], start[at], head[at], strings[at], mark[at]
        new_head, first = _new(head), _new(head, mark)
        group = np.cumsum(new_head) - 1
        several = np.bincount(group, weights=first)[group] > 1
        again, ask = _later(first, doc, start), first & several
        one, two, owner = united(start[again], start[again] + strings[again] - 1 + DEPTH, doc[again])
        return pd.concat([_spans(owner, COVER, one, two), _spans(doc[ask], REQUEST, start[ask], strings[ask])], ignore_index=True)

    return blocks.groupBy("grp").applyInPandas(solve, SPANS)


def dictionary_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the dictionary: the requested phrases' bytes (mark), first places (start) and
    numbers of strings, by trigger. texts: doc_id, text, asked (list of pairs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            asked, one, two = _listed(batch.column("asked"))
            upto = np.concatenate([[0], np.cumsum(asked)])
            base = 0
            for ids, parser, ends in _parsed(batch):
                n = len(ids)
                row = np.repeat(np.arange(n), asked[base : base + n])
                start, count = (x[upto[base] : upto[base + n]] for x in (one, two))
                base += n
                # rows that repeat a doc_id with another text may be asked for places they don't have
                fits = start + ends[row] + count - 1 + DEPTH <= ends[row + 1]
                row, start, count = row[fits], start[fits], count[fits]
                if not len(row):
                    continue
                begin, length = start + ends[row], count - 1 + DEPTH
                trigger = parser.gram[parser.anchor[begin]]
                out = []
                for b, k in _by_bucket(((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets):
                    inside = np.repeat(begin[k] - np.concatenate([[0], np.cumsum(length[k])[:-1]]), length[k]) + np.arange(length[k].sum())
                    out.append((b, *_runs(ids[row[k]]), None, parser.data[inside].tobytes(), start[k].astype(np.uint32).tobytes(), count[k].astype(np.uint8).tobytes()))
                yield _batch(out)

    return texts.mapInArrow(rows, BLOCKS)


def suffix_ranks(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Of each place of data the rank of the `depth` bytes there in alphabetical order, equal
    for equal ones, by prefix doubling. Bytes beyond the end count as zeros."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    rank, known = padded.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        pair = (rank[:-step] << 32) | rank[step:]
        rank, known = np.unique(pair, return_inverse=True)[1].astype(np.int64), known + step
    return rank[: len(data)]


def suffix_repeats(blocks: DataFrame) -> DataFrame:
    """Places of strings that start earlier too, among the strings of requested phrases."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        count = _column(frame, "strings", np.uint8).astype(np.int64)
        doc = np.repeat(_docs(frame), count)
        before = lambda n: np.cumsum(n) - n
        inside = np.arange(count.sum()) - np.repeat(before(count), count)
        start = np.repeat(_column(frame, "start", np.uint32).astype(np.int64), count) + inside
        rank = suffix_ranks(_column(frame, "mark", np.uint8))[np.repeat(before(count - 1 + DEPTH), count) + inside]
        at = np.lexsort((start, doc, rank))
        again = at[_later(_new(rank[at]), doc[at], start[at])]
        one, two, doc = united(start[again], start[again] + DEPTH, doc[again])
        return _spans(doc, COVER, one, two)

    return blocks.groupBy("grp").applyInPandas(solve, SPANS)


def cut_out(texts: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """What is left of each text (doc_id, text, covers) without its covered places."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            many, first, last = _listed(batch.column("covers"))
            upto = np.concatenate([[0], np.cumsum(many)])
            out: list[list] = [[] for _ in names[1:]]
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text, removed, spans = data[a:b], 0, 0
                if many[k]:
                    own = slice(upto[k], upto[k + 1])
                    one, two, _ = united(np.minimum(first[own], b - a), np.minimum(last[own], b - a), np.zeros(many[k], np.int8))
                    stay = np.ones(b - a, bool)
                    for i, j in zip(one.tolist(), two.tolist(), strict=True):
                        stay[i:j] = False
                    removed, spans = int((~stay).sum()), int((two > one).sum())
                    text = text[stay]
                kept = text.tobytes()
                for c, v in zip(out, (b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=False))], names)

    return texts.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def passage_dedup(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    texts = _texts(docs)
    placed = texts.where("doc_id is not null")
    size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (PHRASE_BYTES * BUCKET_PHRASES)))
    found = durable(repeats(phrase_blocks(placed, hot_triggers(placed), buckets), buckets), "repeats")
    asked = found.where(F.col("kind") == REQUEST)
    size = asked.agg(F.sum(F.col("two") - 1 + DEPTH)).first()[0]
    covers = found.where(F.col("kind") == COVER).select("doc_id", "one", "two")
    pairs = F.collect_list(F.struct("one", "two"))
    if size:
        wanted = asked.groupBy("doc_id").agg(pairs.alias("asked"))
        blocks = dictionary_blocks(placed.join(wanted, "doc_id").select("doc_id", "text", "asked"), -(-size // BUCKET_BYTES))
        covers = covers.unionAll(suffix_repeats(blocks).select("doc_id", "one", "two"))
    per_doc = covers.groupBy("doc_id").agg(pairs.alias("covers"))
    out = cut_out(placed.join(per_doc, "doc_id", "left").select("doc_id", "text", "covers"), keep_bytes)
    rest = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<one: int, two: int>>").alias("covers"))
    return out.unionAll(cut_out(rest, keep_bytes))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(documents(spark, sf_dir))
