"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is cut into F slots, F the least Fibonacci number with no more than SLOT_WORDS words a
slot, at every size of input. Slot i has the point i * G / F modulo 1, G the Fibonacci number
before F: their quotient is the golden ratio as near as F slots can tell. The point falls into
one source's share of the unit interval, so any run of slots holds the sources in their
proportions. The slots are listed (slot_sources) and ranked within their source, and the slot
of rank r takes the r-th block (a slot's words) of that source's documents, laid end to end in
shuffled order (by the MD5 digest of the doc_id) and read up to three times over: documents are
cut at the blocks' ends, blocks meet their slots in a join, and what a document gives is summed
over its blocks.

A source's slots may be one short of its target, as shares seldom end at a slot's. It makes
that up in closing slots after the F-th (closing_slots), and its last block ends with its
target, so each source is within a word of it.

Native: DataFrame functions only. Running sums never order a whole source in one task:
rows are dealt into buckets by the head of their digest, summed per bucket, and the
buckets' sums are accumulated; the same holds for the slots' ranks.

Edge cases: a null text has size 0; a null source is a source of its own, last in order.
Rows that repeat a doc_id are taken as rows of their own. Sources without words have
target 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.buffers import documents, durable, fresh

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SLOT_WORDS = 16
DIGEST_HEAD = 3  # hex digits: 4096 buckets a source
FIBONACCI = [1, 2]
while FIBONACCI[-1] < 1 << 52:
    FIBONACCI.append(FIBONACCI[-1] + FIBONACCI[-2])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sid (the source's place, from 0), source, source_size, target, start_at, total: shares of the total by weight, where what a
    source cannot give in `epochs` readings goes to the others by weight. Sources in
    ascending order of what a unit of weight costs them fill up first."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = per_source.withColumn("sid", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everyone)["level"])
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight")))
    upto = in_order.rowsBetween(Window.unboundedPreceding, -1)
    return s.select("sid", "source", "source_size", "target", F.coalesce(F.sum("target").over(upto), F.lit(0.0)).alias("start_at"), F.sum("source_size").over(everyone).alias("total"))


def _places(words: Column) -> Column:
    return F.ceil(words * F.col("n_slots") / F.col("total"))


def _block_start(rank: Column) -> Column:
    """Where a source's block begins; the one before ends there."""
    return F.floor(rank.cast("double") * F.col("total") / F.col("n_slots")).cast("long")


def schedule(targets: DataFrame, words: int = 1) -> DataFrame:
    """sid, source, n_slots, slots: how many of the mix's slots, of `words` words at most, each source
    with a target takes; none if targets sum to no words."""
    everyone = Window.partitionBy()
    s = targets.where("total > 0 and target > 0").withColumn("last", F.col("start_at") == F.max("start_at").over(everyone))
    s = s.withColumn("n_slots", F.array_min(F.filter(F.array(*[F.lit(n) for n in FIBONACCI]), lambda n: n * F.lit(float(words)) >= F.col("total"))))
    # the last share ends at 1 but for rounding; it takes what lies above
    end = F.when(F.col("last"), F.col("n_slots")).otherwise(_places(F.col("start_at") + F.col("target")))
    return s.select("sid", "source", "n_slots", (end - _places(F.col("start_at"))).alias("slots"))


def slot_sources(targets: DataFrame, words: int = 1) -> DataFrame:
    """slot, sid, source, rank: the schedule in full, a row a slot of `words` words at most."""
    spark = targets.sparkSession
    share = targets.join(schedule(targets, words).select("sid", "n_slots", "slots"), "sid").select("sid", "source", "n_slots", _places(F.col("start_at")).alias("lo"), "slots")
    n = share.agg(F.max("n_slots")).first()[0] or 0
    before = next((a for a, b in zip(FIBONACCI, FIBONACCI[1:], strict=False) if b == n), 1)
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id").cast("decimal(20,0)") * before % max(n, 1)).cast("long").alias("point"))
    width = max(1, n // 1024)
    cells = durable(share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("slots")) / width)))), "cells")
    placed = points.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell").where("point >= lo and point < lo + slots").withColumn("part", F.floor(F.col("slot") / 4096))
    own = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1
    counts = placed.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")
    bases = counts.select("sid", "part", earlier.alias("base"))
    return placed.withColumn("own", own).join(bases, ["sid", "part"]).select("slot", "sid", "source", (F.col("base") + F.col("own")).alias("rank"))


def closing_slots(shares: DataFrame) -> DataFrame:
    """sid, rank of the slots after the schedule's end that make up what a source's slots leave of its
    words. shares: sid, words, total, n_slots, slots."""
    short = shares.where(_block_start(F.col("slots")) < F.col("words"))
    return short.select("sid", F.explode(F.sequence("slots", F.greatest("slots", _places(F.col("words"))))).alias("rank"))


def shuffled_spans(sizes: DataFrame, head: int = DIGEST_HEAD) -> DataFrame:
    """sizes with begin: words of the documents before it in its source's shuffled order."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, head))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return placed.join(bases, placed["source"].eqNullSafe(bases["_s"]) & (placed["bucket"] == bases["_b"])).withColumn("begin", F.col("base") + F.col("own")).drop("_s", "_b", "base", "own", "bucket", "digest")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    return _taken(docs, weights, epochs).select("doc_id", "size", "source_size", "target", "taken")


def _row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("mark")]


def _taken(docs: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """mix with the rows' keys: doc_id, source and mark (a hash of the text)."""
    sizes = durable(docs.select(*_row_key(docs), word_count(F.col("text")).alias("size")), "sizes")
    targets = durable(source_targets(sizes, weights, epochs), "targets")
    words = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * F.lit(epochs))
    plan = schedule(targets, SLOT_WORDS).select("sid", "n_slots", "slots")
    t = durable(targets.join(plan, "sid", "left").select("sid", F.col("source").alias("_s"), "source_size", "target", words.alias("words"), "total", "n_slots", "slots"), "shares")
    spans = shuffled_spans(sizes)
    spans = durable(spans.join(t, spans["source"].eqNullSafe(t["_s"])).drop("_s"), "spans")
    slots = slot_sources(targets, SLOT_WORDS).select("sid", "rank").unionAll(closing_slots(t))
    read = _blocks(spans, epochs).join(slots.hint("merge"), ["sid", "rank"]).groupBy("sid", "begin").agg(F.sum("words_read").alias("taken"))
    # documents without words begin where others do
    read = read.withColumn("some", F.lit(True))
    joined = spans.withColumn("some", F.col("size") > 0).join(read, ["sid", "begin", "some"], "left")
    return joined.select("doc_id", "source", "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _blocks(spans: DataFrame, epochs: int) -> DataFrame:
    """sid, begin, rank, words_read: each document (sid, begin) in the blocks of its source that it
    reaches into, with its words there. Reading e covers [e * source_size, (e + 1) * source_size);
    the last block ends with the source's words."""
    r = spans.where("size > 0 and n_slots is not null").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    r = r.withColumn("at", F.col("begin") + F.col("e") * F.col("source_size")).where("at < words").withColumn("end", F.least(F.col("at") + F.col("size"), "words"))
    near = lambda place: F.floor(place.cast("double") * F.col("n_slots") / F.col("total"))
    # one block more on either side, for rounding; those that it doesn't reach into go
    r = r.withColumn("rank", F.explode(F.sequence(F.greatest(F.lit(0), near(F.col("at")) - 1), near(F.col("end")) + 1)))
    inside = F.least("end", _block_start(F.col("rank") + 1)) - F.greatest("at", _block_start(F.col("rank")))
    return r.select("sid", "begin", "rank", inside.alias("words_read")).where("words_read > 0")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix takes them: each row as often as it is read, to the nearest whole; rows
    without words aren't part of a mix. Rows that repeat doc_id, source and text share the
    largest of their counts."""
    taken = _taken(docs, weights, epochs).where("taken > 0")
    copies = taken.groupBy("doc_id", "source", "mark").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies")).where("copies > 0")
    own, other = fresh(docs, "own_id", "own_source", "own_mark"), fresh(docs, "doc", "from", "hash", "copies", "copy")
    copies = durable(copies, "copies").toDF(*other[:4])
    keyed = docs.select("*", *[c.alias(name) for c, name in zip(_row_key(docs), own, strict=True)])
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, other, strict=False)]
    joined = keyed.join(copies, same[0] & same[1] & same[2])
    return joined.withColumn(other[4], F.explode(F.sequence(F.lit(1), F.col(other[3])))).select(docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM per_source),
filling AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighed),
leveled AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM filling WHERE cap > level * weight) AS open_level FROM filling),
targets AS (SELECT source, source_size, total, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE) ELSE open_level * weight END AS target FROM leveled),
starts AS (SELECT *, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start_at FROM targets),
fibonacci AS (WITH RECURSIVE f(a, b) AS (SELECT 1::BIGINT, 2::BIGINT UNION ALL SELECT b, a + b FROM f WHERE b < 4503599627370496) SELECT a AS n, greatest(1, b - a) AS before FROM f),
sized AS (SELECT min(n) AS n_slots, arg_min(before, n) AS before FROM fibonacci, (SELECT max(total) AS t FROM targets) WHERE n * 16e0 >= t),
places AS (SELECT *, start_at = max(start_at) OVER () AS last, ceil(start_at * n_slots / total) AS lo FROM starts, sized WHERE target > 0 AND total > 0),
bounds AS (SELECT *, CASE WHEN last THEN n_slots ELSE ceil((start_at + target) * n_slots / total) END AS hi FROM places),
points AS (SELECT i AS slot, CAST(CAST(i AS HUGEINT) * before % n_slots AS BIGINT) AS point FROM (SELECT unnest(range(n_slots)) AS i, before, n_slots FROM sized)),
ranked AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN bounds ON point >= lo AND point < hi),
words AS (SELECT t.*, least(CAST(floor(target + 0.5e0) AS BIGINT), 3 * source_size) AS upto, n_slots FROM targets t, sized),
closing AS (SELECT w.source, unnest(range(slots, greatest(slots, CAST(ceil(upto * CAST(w.n_slots AS DOUBLE) / w.total) AS BIGINT)) + 1)) AS rank
  FROM words w JOIN (SELECT source, CAST(hi - lo AS BIGINT) AS slots FROM bounds) b ON w.source IS NOT DISTINCT FROM b.source WHERE floor(CAST(slots AS DOUBLE) * w.total / w.n_slots) < upto),
slots AS (SELECT * FROM ranked UNION ALL SELECT * FROM closing),
blocks AS (SELECT s.source, rank, CAST(floor(CAST(rank AS DOUBLE) * total / n_slots) AS BIGINT) AS first, least(upto, CAST(floor(CAST(rank + 1 AS DOUBLE) * total / n_slots) AS BIGINT)) AS past FROM slots s JOIN words w ON s.source IS NOT DISTINCT FROM w.source),
spans AS (SELECT *, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes),
readings AS (SELECT s.source, rid, start + e * source_size AS since, start + e * source_size + size AS past FROM spans s JOIN words w ON s.source IS NOT DISTINCT FROM w.source, range(3) r(e) WHERE size > 0),
reached AS (SELECT r.*, unnest(range(greatest(0, CAST(floor(since * CAST(n_slots AS DOUBLE) / total) AS BIGINT) - 1), CAST(floor(r.past * CAST(n_slots AS DOUBLE) / total) AS BIGINT) + 2)) AS rank FROM readings r JOIN words w ON r.source IS NOT DISTINCT FROM w.source),
given AS (SELECT rid, sum(greatest(0, least(r.past, b.past) - greatest(since, first))) AS taken FROM reached r JOIN blocks b ON r.source IS NOT DISTINCT FROM b.source AND r.rank = b.rank GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM spans s JOIN words w ON s.source IS NOT DISTINCT FROM w.source LEFT JOIN given g ON s.rid = g.rid
"""
