"""N-gram Jaccard join with multiple-global-order prefix filters.

A document's set holds its distinct shingles of five words (see shingles). Two documents
link when their sets' Jaccard similarity is 0.8 or more, compared in whole numbers.

1. Sets are named by a 128-bit digest; equal sets are one class from here on.
2. A count sketch of 2**SKETCH_BITS cells over all shingles puts each into a level of
   frequency. ORDERS global token orders sort by level, rare ones first, and within a level
   by a hash of their own, so each order is another permutation.
3. Under every order, the prefix of a set of n shingles is its first n - ceil(0.8 n) + 1.
   Linked sets share a prefix token under each order, and their first COMMON common tokens
   if the prefixes are longer by so many. Sets that don't meet sets of fitting size in so
   many tokens under the first order are done; only the others' texts are read again. For
   this, packed postings travel by token; tokens that the sketch calls frequent are shared
   anyway and aren't posted, so no task gathers the postings of a hot token.
4. A candidate shares prefix tokens under every order: pairs from the first order are
   intersected with the other orders' filters before the sets are compared. Under the first
   order, what follows the shared token must be enough for a link in both sets, as it is
   after the first token that linked sets share.
5. Pairs are made between components only. Stars come first: the sets whose first tokens
   under some order are equal meet one of them. Then the sets outside a token's commonest
   component meet HEARTS sets of it, others each turn, where meeting all would make many
   pairs (SETTLED * LEFT); else they meet all sets of other components there. When all the
   rest makes no more than LEFT pairs a set, or less than a quarter of a turn's pairs were
   links, or less than one a GAIN sets, all tokens are settled so. A token's sets are dealt into blocks for that, so a hot token is many tasks.
   A set's marks tell for each of 64 * MARKS cells whether an odd number of its shingles
   falls into it. Marks of two sets differ in no more cells than their sets do in shingles, so
   most sets that merely share a passage make no pair where they meet.
6. Each turn's links join the components found so far; a component is named by its
   smallest doc_id in the end.

This finds every component and every link that makes one; links inside a component that is
already known to be one are not counted out.

Edge cases: null, empty and white-space texts have no shingles and link with nothing; their
component is their own doc_id. Texts of fewer than five words are one shingle. Rows with a
null doc_id have a null component and link with nothing. Rows that repeat a doc_id are one
document if their texts have the same set. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.buffers import discard, documents, durable, marked_possible, mix64, in_parts, small_batches, utf8, without
from plumbline.llm.shingles import shingle_sets
from plumbline.operators.components import linked_components

SKETCH_BITS = 20
SLICES = 16
FAN = 32
ORDERS = 3
HOT_LEVEL = 1 << 7
HOT_TIMES, HOT_LEAST = 8, 256
BUCKET_POSTINGS = 1 << 19
HELD_POSTINGS = 1 << 18
SEEN_KEPT = 1 << 17
LEVEL_STEP = 1.25
LEFT = 16
MARKS = 8
GAIN = 64
SETTLED = 16
HEARTS = 4
COMMON = 8
BLOCK_SETS = 256
FEW = 64
TEXT_ROWS = 2048
SET_ROWS = 512
HEAVY = 1000
_MARKS = [f"m{k}" for k in range(MARKS)]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _key(digest: bytes | None) -> int | None:
    return digest and int.from_bytes(digest[:8], "little", signed=True)


def set_profiles(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a row's doc_id, mark (hash of its text), n_shingles, digest, key (the
    digest's head); and a task's share of the count sketch as slice, part, counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            n, digests = [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                digests.append(_digest(s))
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([_key(d) for d in digests], pa.int64()), *none], names)
        parts = [p.tobytes() for p in np.split(np.minimum(sketch, 65_535).astype(np.uint16), SLICES)]
        none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "mark", "n_shingles", "digest", "key", "slice", "part", "counts"]
    return _texts(docs).mapInArrow(rows, "doc_id long, mark long, n_shingles long, digest binary, key long, slice int, part int, counts binary")


def frequency_levels(profiles: DataFrame) -> np.ndarray:
    """Level of each sketch cell: 0 up to LEVEL_STEP times the mean, then one for each such
    step, 63 at most; with HOT_LEVEL added for frequent cells. One byte a cell, whatever the
    input."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.int64)
        for c in frame["counts"]:
            total += np.frombuffer(c, np.uint16 if len(c) == 2 * len(total) else np.int64)
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "part": [frame["part"].iloc[0]], "counts": [total.tobytes()]})

    sums = profiles.where("slice is not null").select("slice", "part", "counts")
    parts = sums.agg(F.max("part")).first()[0] or 0
    while True:  # a sum is of FAN shares at most
        by_share = sums.select("slice", F.floor(F.col("part") / FAN).cast("int").alias("part"), "counts")
        sums = by_share.groupBy("slice", "part").applyInPandas(add, "slice int, part int, counts binary")
        parts //= FAN
        if not parts:
            break
        sums = durable(sums, "sums")
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES))
    for s in sums.toLocalIterator():
        counts[s["slice"]] = np.frombuffer(s["counts"], np.int64)
    counts = counts.ravel()
    mean = max(counts.mean(), 1.0)
    levels = np.minimum(np.log(np.maximum(counts / mean, 1.0)) / np.log(LEVEL_STEP), 63).astype(np.uint8)
    return levels + np.where(counts >= HOT_TIMES * mean + HOT_LEAST, HOT_LEVEL, 0).astype(np.uint8)


def prefix(shingles: np.ndarray, levels: np.ndarray, order: int, common: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set under an order, first tokens first, and which of them are frequent.
    Linked sets have their first `common` common tokens (if they have so many) in prefixes."""
    n = len(shingles)
    take = min(n, n - -(-4 * n // 5) + common)
    level = levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    rank = ((level & np.uint8(63)).astype(np.uint64) << np.uint64(58)) | (mix64(shingles + np.uint64(0x632BE59BD9B4E019 * (order + 1) % (1 << 64))) >> np.uint64(6))
    first = np.argpartition(rank, take - 1)[:take] if take < n else np.arange(n)
    first = first[np.argsort(rank[first])]
    return shingles[first], level[first] >= HOT_LEVEL


def marks(shingles: np.ndarray) -> np.ndarray:
    """MARKS words, a bit for each cell: whether an odd number of the shingles falls into it."""
    cells = 64 * MARKS
    cell = (mix64(shingles + np.uint64(0xD1B54A32D192ED03)) % np.uint64(cells)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def posting_blocks(docs: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """Packed postings of the first order: by token bucket (grp) tokens' low halves, their
    places in the order, keys and sizes of their sets. Frequent tokens are only counted (keys
    and numbers, grp of the key, above the buckets). A task posts a set
    once, however many copies it reads (it remembers SEEN_KEPT sets)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        shared: list[tuple[int, int]] = []
        postings = 0

        def packed() -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            if held:
                token, place = (np.concatenate([h[k] for h in held]) for k in (2, 3))
                lengths = [len(h[2]) for h in held]
                key = np.repeat(np.array([h[0] for h in held], np.int64), lengths)
                size = np.repeat(np.array([h[1] for h in held], np.int32), lengths)
                bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                at = np.lexsort((token, bucket))
                ends = np.searchsorted(bucket[at], np.arange(buckets + 1))
                for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                    k = at[ends[b] : ends[b + 1]]
                    for c, v in zip(out, (b, token[k].astype(np.uint32).tobytes(), place[k].tobytes(), key[k].tobytes(), size[k].tobytes()), strict=True):
                        c.append(v)
            if shared:
                key, many = np.array([k for k, _ in shared], np.int64), np.array([n for _, n in shared], np.int32)
                for b in np.unique(key % buckets).tolist():
                    own = key % buckets == b
                    for c, v in zip(out, (buckets + b, b"", b"", key[own].tobytes(), many[own].tobytes()), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["grp", "tokens", "places", "keys", "sizes"])

        for batch in in_parts(batches):
            data, offsets = utf8(batch.column("text"))
            for s in shingle_sets(data, offsets):
                if not len(s) or (key := _key(_digest(s))) in seen:
                    continue
                if len(seen) >= SEEN_KEPT:
                    seen.clear()
                seen.add(key)
                tokens, frequent = prefix(s, levels, 0, COMMON)
                if frequent.any():
                    shared.append((key, int(frequent.sum())))
                if not frequent.all():
                    # a place beyond the type's range counts as an earlier one, which keeps more sets
                    place = np.minimum(np.flatnonzero(~frequent), 65_535).astype(np.uint16)
                    held.append((key, len(s), tokens[~frequent], place))
                    postings += len(tokens)
                if postings + len(shared) > HELD_POSTINGS:
                    yield packed()
                    held, shared, postings = [], [], 0
        yield packed()

    return _texts(docs.where("doc_id is not null")).mapInArrow(rows, "grp int, tokens binary, places binary, keys binary, sizes binary")


def needed_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of sizes a and b."""
    return -(-4 * (a + b) // 9)


def sharing(token: np.ndarray, place: np.ndarray, size: np.ndarray, most: int = FEW) -> np.ndarray:
    """Postings, sorted by token and size, of sets that can link with another one that holds
    the token: by their sizes, and by what follows the token, the COMMON-th common one at the
    latest. At tokens of more than `most` postings all count."""
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
    count = np.diff(edge)
    out, last = np.repeat(count > most, count), np.repeat(edge[1:], count)
    at = np.flatnonzero(~out)
    for lag in range(1, most):
        at = at[at + lag < last[at]]
        to = at + lag
        fits = (5 * size[at] >= 4 * size[to]) & (np.minimum(size[at] - place[at], size[to] - place[to]) > needed_overlap(size[at], size[to]) - COMMON)
        out[at[fits]] = out[to[fits]] = True
    return out


def sharing_sets(blocks: DataFrame, buckets: int) -> DataFrame:
    """key, shared: in how many prefix tokens a set meets sets that it can link with. Posting a
    set twice doesn't make it meet."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.int64) for x in frame["keys"]])
        size = np.concatenate([np.frombuffer(x, np.int32) for x in frame["sizes"]]).astype(np.int64)
        if int(frame["grp"].iloc[0]) >= buckets:  # numbers of frequent tokens
            return pd.DataFrame({"key": key, "shared": size}).drop_duplicates("key")
        token, place = (np.concatenate([np.frombuffer(x, kind) for x in frame[c]]) for c, kind in (("tokens", np.uint32), ("places", np.uint16)))
        at = np.lexsort((place, key, size, token))
        token, key = token[at], key[at]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
        at = at[new]
        key, shared = np.unique(key[new][sharing(token[new], place[at].astype(np.int64), size[at])], return_counts=True)
        return pd.DataFrame({"key": key, "shared": shared})

    return blocks.groupBy("grp").applyInPandas(match, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))


def shingle_table(docs: DataFrame, reps: DataFrame, levels: np.ndarray) -> DataFrame:
    """node, digest, n, shingles, prefixes p0, p1, p2 (one for each order) and marks m0, m1, ... of the
    sets of the rows in reps (doc_id, mark)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
            flat = (np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)).astype(kind)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat))

        for batch in in_parts(batches):
            sets = [s for s in shingle_sets(*utf8(batch.column("text"))) if len(s)]
            # the other orders only filter, for which half a token does
            columns = [listed([prefix(s, levels, k)[0] for s in sets], np.int32 if k else np.int64) for k in range(ORDERS)]
            told = np.array([marks(s) for s in sets], np.int64).reshape(len(sets), MARKS)
            columns += [pa.array(told[:, k].copy()) for k in range(MARKS)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), listed(sets), *columns], names)

    names = ["digest", "n", "shingles", *(f"p{k}" for k in range(ORDERS)), *_MARKS]
    texts = _texts(docs)
    near = marked_possible(texts, reps, ["doc_id", "mark"], "near").where("near").dropDuplicates(["doc_id", "mark"])
    made = near.join(reps, ["doc_id", "mark"], "left_semi").select("text").mapInArrow(rows, "digest binary, n long, shingles array<long>, " + ", ".join([f"p{k} array<{'int' if k else 'long'}>" for k in range(ORDERS)] + [f"{m} long" for m in _MARKS]))
    return made.select(F.monotonically_increasing_id().alias("node"), *names)


def first_stars(sets: DataFrame) -> DataFrame:
    """a, b: sets whose first tokens under some order are equal, each with the one of least node."""
    firsts = F.array(*[F.struct(F.lit(k).alias("ord"), F.col(f"p{k}")[0].cast("long").alias("token")) for k in range(ORDERS)])
    rows = sets.select("node", F.inline(firsts))
    hearts = rows.groupBy("ord", "token").agg(F.min("node").alias("heart"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    return rows.join(hearts, ["ord", "token"]).where("node <> heart").select(F.col("heart").alias("a"), F.col("node").alias("b")).distinct()


def _sided(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    for s in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("node").alias(s), *[F.col(c).alias(c + s) for c in columns]), s)
    return pairs


def _named(sets: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The sets that may be in a pair."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    return marked_possible(sets.select("node", *columns), ends, ["node"], "named").where("named").drop("named")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among the pairs (a, b): the orders' filters are intersected, then the
    sets of what is left."""
    others = [f"p{k}" for k in range(1, ORDERS)]
    fits = reduce(lambda x, y: x & y, [F.arrays_overlap(p + "a", p + "b") for p in others], F.expr("5 * least(na, nb) >= 4 * greatest(na, nb)"))
    candidates = durable(_sided(pairs, _named(sets, pairs, ["n", *others]), ["n", *others]).where(fits).select("a", "b"), "candidates")
    both = F.size(F.array_intersect("shinglesa", "shinglesb"))
    named = _named(sets, candidates, ["n", "shingles"])
    found = durable(_sided(candidates, named, ["n", "shingles"]).where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
    discard(candidates)
    return found


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label of every linked node: the components of labels, joined by the links."""
    if labels is None:
        return linked_components(links)
    ends = links
    for s in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(s), F.col("label").alias("l" + s)), s, "left")
    over = linked_components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    alone = over.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti")
    moved = over.select(F.col("node").alias("label"), F.col("label").alias("top"))
    new = durable(labels.unionByName(alone).join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
    for x in (over, labels):
        discard(x)
    return new


def open_members(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """token, place, node, n, comp, marks: prefixes under the first order, at tokens that sets of
    several components share."""
    known = sets.select("node", "n", "p0", *_MARKS).join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("comp"), "p0", *_MARKS)
    rows = known.select("node", "n", "comp", F.posexplode("p0").alias("place", "token"), *_MARKS)
    several = rows.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("token")
    return durable(rows.join(several, "token"), "open")


def still_open(members: DataFrame, tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the tokens, in the components of now."""
    rows = members.join(tokens.select("token"), "token", "left_semi").join(labels, "node", "left")
    return durable(rows.select("token", "place", "node", "n", F.coalesce("label", "comp").alias("comp"), *_MARKS), "open")


def token_hearts(members: DataFrame, turn: int) -> DataFrame:
    """token, sets, most, common, hearts: number of sets, those in the token's commonest
    component, and HEARTS sets of that component, others each turn."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HEARTS + k)).alias("rank"), F.col("node").alias("node"))).alias(f"h{k}") for k in range(HEARTS)]
    per_component = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), *first)
    best = F.max(F.struct("n", "comp", F.array_distinct(F.array(*[F.col(f"h{k}.node") for k in range(HEARTS)])).alias("nodes"))).alias("best")
    return per_component.groupBy("token").agg(F.sum("n").alias("sets"), best).select("token", "sets", F.col("best.n").alias("most"), F.col("best.comp").alias("common"), F.col("best.nodes").alias("hearts"))


# sizes that allow a link, enough of both sets after the shared token, and marks that differ in
# no more cells than linked sets differ in shingles: in a ninth of both sizes
_FITS = (
    "ca <> cb and 5 * least(na, nb) >= 4 * greatest(na, nb) and least(na - ata, nb - atb) >= (4 * (na + nb) + 8) div 9"
    f" and 9 * ({' + '.join(f'bit_count({m}a ^ {m}b)' for m in _MARKS)}) <= na + nb"
)


def _member(s: str) -> list:
    return [F.col(c).alias(n + s) for c, n in (("node", ""), ("n", "n"), ("comp", "c"), ("place", "at"), *zip(_MARKS, _MARKS, strict=True))]


def _fitting(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    pairs = left.join(right, on).where(_FITS)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(members: DataFrame, hearts: DataFrame) -> DataFrame:
    """a, b: at each token, the sets outside its commonest component with the hearts of it."""
    at_heart = members.join(hearts.select("token", F.explode("hearts").alias("node")), ["token", "node"])
    others = members.join(hearts.select("token", "common"), "token").where("comp <> common")
    return _fitting(others.select("token", *_member("a")), at_heart.select("token", *_member("b")), ["token"])


def left_over_pairs(members: DataFrame, hearts: DataFrame) -> DataFrame:
    """a, b: at each token, the sets outside its commonest component with all sets of other
    components, block by block."""
    dealt = hearts.select("token", "common", F.ceil(F.col("sets") / F.lit(BLOCK_SETS)).cast("int").alias("blocks"))
    rows = members.join(dealt, "token")
    left = rows.where("comp <> common").select("token", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), *_member("a"))
    right = rows.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *_member("b"))
    return _fitting(left, right, ["token", "block"])


def components(sets: DataFrame, left: int = LEFT) -> DataFrame | None:
    """node, label of every linked set; nothing if there is no link."""
    stars = durable(first_stars(sets), "stars")
    links = linked(stars, sets)
    none = sets.sparkSession.createDataFrame([], "node long, label long")
    labels = None if links.isEmpty() else joined(None, links)
    for x in (stars, links):
        discard(x)
    members, turn = open_members(sets, none if labels is None else labels), 0
    many, gained = sets.count(), True
    while True:
        hearts = durable(token_hearts(members, turn).where("sets > most"), "hearts")
        made = (F.col("sets") - F.col("most")).cast("double") * F.col("sets")
        size = hearts.agg(F.count(F.lit(1)).alias("all"), F.sum(F.when(made > SETTLED * left, made)).alias("pairs")).first()
        if not size["all"]:
            for x in (members, hearts):
                discard(x)
            return labels
        # stars end when a turn joined few of the pairs it made or few sets, or when all pairs are few enough
        stars = gained and (size["pairs"] or 0) > left * many
        wide = made > SETTLED * left if stars else F.lit(False)
        pairs = [left_over_pairs(members, hearts.where(~wide))]
        if stars:
            pairs.append(star_pairs(members, hearts.where(wide)))
        pairs = durable(reduce(DataFrame.unionAll, pairs).distinct(), "pairs")
        links = linked(pairs, sets)
        found = links.count()
        gained = 4 * found >= max(pairs.count(), 1) and GAIN * found >= many
        if found:
            labels = joined(labels, links)
        for x in (links, pairs):
            discard(x)
        if not stars:
            for x in (members, hearts):
                discard(x)
            return labels
        before, members = members, still_open(members, hearts.where(wide), none if labels is None else labels)
        for x in (before, hearts):
            discard(x)
        turn += 1


def near_rows(docs: DataFrame, left: int = LEFT) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id of every row of docs."""
    with small_batches(docs.sparkSession, TEXT_ROWS):
        profiles = durable(set_profiles(docs), "profiles")
        rows = profiles.where("slice is null")
        # a prefix has a fifth of its set's shingles and COMMON more, whatever the texts' lengths
        count, postings = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("n_shingles") > 0, F.col("n_shingles") / 5 + COMMON))).first()
        buckets = max(1, math.ceil((postings or 0) / BUCKET_POSTINGS))
        levels = frequency_levels(profiles)
        keys = durable(sharing_sets(posting_blocks(docs, levels, buckets), buckets), "sharing")
    named = rows.where("digest is not null and doc_id is not null")
    classes = named.groupBy("digest", "key", "n_shingles").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = durable(classes.select("digest", "key", "n_shingles", "copies", F.col("first.doc_id").alias("rep"), "first.mark"), "classes")
    # a partner has 0.8 n shingles at least, 0.8 of which are common at least
    met = classes.join(keys, "key").where(F.col("shared") >= F.least(F.lit(COMMON), F.ceil(0.64 * F.col("n_shingles"))))
    reps = durable(met.select(F.col("rep").alias("doc_id"), "mark"), "reps")
    with small_batches(docs.sparkSession, SET_ROWS):
        sets = durable(shingle_table(docs, reps, levels), "sets")
    labels = components(sets, left)
    shared = classes.where("copies > 1").select("digest", "copies", F.col("rep").alias("component_id"))
    if labels is not None:
        member = durable(sets.select("node", "digest").join(labels, "node").join(classes.select("digest", "rep", "copies"), "digest").select("digest", "copies", "label", "rep"), "members")
        names = durable(member.groupBy("label").agg(F.min("rep").alias("component_id")), "names")
        found = durable(member.join(names, "label").select("digest", "copies", "component_id"), "found")
        shared = shared.join(found, "digest", "left_anti").unionByName(found)
    shared = durable(shared, "shared")
    for x in (keys, reps, sets):
        discard(x)
    # HEAVY classes at most hold that share of the rows each; no key of the other join does
    heavy = F.col("copies") * HEAVY >= count
    wide, slim = (shared.where(c).select("digest", "component_id") for c in (heavy, ~heavy))
    wanted = rows.select("doc_id", "mark", "n_shingles", "digest")
    full = wanted.where("digest is not null").join(F.broadcast(wide), "digest", "left")
    rest = full.where("component_id is null").drop("component_id").join(slim, "digest", "left").select(full.columns)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    every = full.where("component_id is not null").unionAll(rest).select("doc_id", "mark", "n_shingles", own.alias("component_id"))
    return every.unionAll(wanted.where("digest is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, left: int = LEFT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return near_rows(docs, left).drop("mark")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest
    doc_id. Rows without shingles or doc_id stay; so do rows that share a doc_id with a near
    copy but have another text. Rows that repeat both doc_id and text stay or go together."""
    gone = durable(near_rows(docs).where("component_id <> doc_id").select("doc_id", "mark").distinct(), "gone")
    return without(docs, gone, F.xxhash64(F.col("text").cast("string")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
