"""Best-fit packing of tokenised documents with swap-based local search.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt at random into
groups of a few thousand; each group is packed by best fit in falling order of length,
then improved: documents move, or change places one for one or two for one, between
underfull sequences wherever that raises the sum of squared fills, until no exchange
helps (or for SWEEPS sweeps; a sequence tries the RECEIVERS fullest others, and pairs of its
documents if it has PAIRED at most: bounds on a search that gets by without them on text);
sequences that empty are gone. What is left in underfull sequences of all groups
is dealt into fewer groups and packed again, as long as that at least halves the rest.
No group's size depends on the number of documents, so none outgrows a task.

Edge cases: a null or empty text is the single end token. Rows that repeat a doc_id are
packed as rows of their own. A text of any length is cut only at multiples of CAPACITY.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import byte_table, documents, durable, mix64, in_parts, utf8
from plumbline.llm.ngrams import slabs
from plumbline.llm.shingles import power_tables

CAPACITY = 2048
GROUP = 4096
END_ID = 0
END = END_ID.to_bytes(4, "little")
RECEIVERS = 32
SWEEPS = 8
PAIRED = 24
WORDS_KEPT = 400_000
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts by way of their words. The vocabulary's tokens never cross white
    space, so a text's ids are its words' ids; nor do they cross from a letter to a mark (but
    for the apostrophe), where a word is cut in two, so that there are fewer words. Each slab's distinct words are
    looked up once, by 64-bit hash, in sorted columns that start anew at WORDS_KEPT words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.fold, self.keep = self.tokenizer.normalizer, Sequence([])
        special = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        if special:
            self.mark = min(special.values())
            self.marks, self.ends = np.zeros((2, 1 + max(self.tokenizer.get_vocab().values())), bool)
            self.marks[[k for k, t in special.items() if t == self.mark]] = True
            self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.hash, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _apart(self, text: str, last: np.ndarray, fold) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and the places after those that end a word."""
        self.tokenizer.normalizer = fold
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        self.tokenizer.normalizer = self.fold
        return ids, np.flatnonzero(last[ids]) + 1

    def _learn(self, at: np.ndarray, hashes: np.ndarray, raw: list[bytes]) -> None:
        """Insert new words (hashes ascending) at their places in the columns. They are encoded
        in two texts. In that of plain words, of small Latin letters alone, each is one run
        that ends with a token marked so; in the other a special token stands after each."""
        words = [w.decode("utf-8", "replace") for w in raw]
        plain = np.array([w.isalpha() and max(w) < "\u0250" and w == w.lower() for w in words], bool)
        count, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for own, fold, mark, last, tail in ((plain, self.keep, " ", self.ends, 0), (~plain, self.fold, self.mark, self.marks, 1)):
            text = "".join([words[k] + mark for k in np.flatnonzero(own).tolist()])
            ids, ends = self._apart(text, last, fold)
            if len(ends) != own.sum():
                raise ValueError("this vocabulary doesn't keep words apart")
            count[own] = np.diff(np.concatenate([[0], ends])) - tail
            first[own] = len(self.ids) + ends - tail - count[own]
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.hash = np.insert(self.hash, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def slab(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and where each text's begin."""
        start, end, text = words_of(data, offsets)
        h = span_hashes(data, start, end)
        distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > WORDS_KEPT:
            self._clear()
        at = np.searchsorted(self.hash, distinct)
        new = np.append(self.hash, np.uint64(0))[at] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        new |= at == len(self.hash)
        if new.any():
            raw = data.tobytes()
            self._learn(at[new], distinct[new], [raw[start[k] : end[k]] for k in example[new].tolist()])
            at = np.searchsorted(self.hash, distinct)
        count = self.count[at][which]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at][which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        begin = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(offsets)))]
        return ids, begin


_STOPS = np.isin(np.arange(256), np.frombuffer(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', np.uint8))
_LETTERS = np.isin(np.arange(256), np.concatenate([np.arange(65, 91), np.arange(97, 123)]))
_BLANKS = np.isin(np.arange(256), np.array([9, 10, 11, 12, 13, 32]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word in texts that lie end to end."""
    cut = np.zeros(len(data) + 1, bool)  # a word begins or ends before this byte
    cut[offsets] = True
    blank = _BLANKS[data]
    cut[1:-1] |= blank[1:] != blank[:-1]
    cut[1:-1] |= _STOPS[data[1:]] & _LETTERS[data[:-1]]
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    word = ~blank[start] if len(start) else np.zeros(0, bool)
    start, end = start[word], end[word]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(67)[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    import public_tokenizers

    return WordIds(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def text_ids(data: np.ndarray, offsets: np.ndarray, words: WordIds, by_words: bool) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, each text's ids with the end id, as little-endian 32-bit integers) of runs
    of texts."""
    for at, part, ends in slabs(data, offsets, block=1 << 20):
        raw = part.tobytes()
        if by_words and b"<|" not in raw:  # special tokens cross white space and tell case apart
            # the vocabulary folds case; folding ASCII here makes fewer words
            ids, begin = words.slab(np.frombuffer(raw.lower(), np.uint8), ends)
        else:
            lists = [words.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            ids = np.array([x for one in lists for x in one], np.uint32)
        stored = ids.astype("<u4").tobytes()
        yield at, [stored[4 * a : 4 * b] + END for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece; with keep_ids also its ids, as little-endian 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        # known to hold for this vocabulary; texts are encoded whole with others
        by_words = vocabulary.rsplit("/", 1)[-1] == VOCABULARY
        step = 4 * capacity
        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            cols: list[list] = [[], [], [], [], [], []]
            doc_ids = batch.column("doc_id").to_pylist()
            for row, texts in text_ids(data, offsets, words, by_words):
                for doc_id, ids in zip(doc_ids[row:], texts, strict=False):
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, PIECES + ", ids binary" * keep_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin it fills best."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit r is set where room[r] has bins
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins


def _exchange(a: list[int], b: list[int], lengths: list[int], gap: int, least: int) -> tuple[list[int], list[int], int] | None:
    """The move, swap or two-for-one swap that carries most tokens (over `least`, up to
    `gap`) from bin a to bin b: what leaves a, what leaves b, tokens carried."""
    best: tuple[list[int], list[int], int] | None = None
    offers = [([i], lengths[i]) for i in a]
    if len(a) <= PAIRED:
        offers += [([i, j], lengths[i] + lengths[j]) for k, i in enumerate(a) for j in a[k + 1 :]]
    returns = [([], 0)] + [([i], lengths[i]) for i in b]
    for out, n in offers:
        for back, m in returns:
            d = n - m
            if least < d <= gap and (best is None or d > best[2]):
                best = (out, back, d)
                if d == gap:
                    return best
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by exchanges between underfull bins until none helps
    (or SWEEPS sweeps are over); drop the bins that empty."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(SWEEPS):
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: fill[k])
        changed = False
        for donor in under:
            # the fullest first: they gain most, and little is missing to close them
            for to in [k for k in reversed(under[-RECEIVERS:]) if k != donor]:
                if not bins[donor] or fill[donor] >= capacity:
                    break
                gap = capacity - fill[to]
                # squares rise by 2 d (fill[to] - fill[donor] + d)
                found = _exchange(bins[donor], bins[to], lengths, gap, max(0, fill[donor] - fill[to])) if gap else None
                if found:
                    out, back, d = found
                    bins[donor] = [i for i in bins[donor] if i not in out] + back
                    bins[to] = [i for i in bins[to] if i not in back] + out
                    fill[donor] -= d
                    fill[to] += d
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_groups(rows: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "fill")]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = frame["length"].tolist()
        sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
        group = int(frame["pack_group"].iloc[0])
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (level << 56) | (group << 24) | k, at
                at += lengths[i]
            fill[items] = at
        return frame[names].assign(sequence_id=sequence, offset=offset, fill=fill)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long, fill long"
    # dealt by a number of the row: rows may repeat a doc_id, or have none
    keyed = rows.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)).alias("pack_group"))
    return keyed.groupBy("pack_group").applyInPandas(pack, schema)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and place there."""
    groups = -(-max(docs.count(), 1) // group)
    done = durable(_pack_groups(pieces(docs, vocabulary, capacity, keep_ids), groups, 0, capacity), "packed")
    whole, level = [], 0
    rest = None
    while groups > 1:
        rest = done.where(F.col("fill") < capacity)
        left = rest.count()
        fewer = -(-max(left, 1) // group)
        if left == 0 or fewer * 2 > groups:
            break
        whole.append(done.where(F.col("fill") == capacity))
        groups, level = fewer, level + 1
        done = durable(_pack_groups(rest, groups, level, capacity), "packed")
    out = done
    for w in whole:
        out = out.unionByName(w)
    return out.drop("fill")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
