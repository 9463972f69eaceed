"""Prefix trie of conversations by ROLLUP over turns in positional columns.

A turn's id is the SHA-256 of its role and text. A conversation becomes one row for each WIDTH
turns, its turn ids in WIDTH columns, and `prior`, the digest of all turns before. One
GROUP BY prior, ROLLUP(t1, ..., tn) then aggregates the prefixes of every length together, and
grouping_id tells their depth: a block's rows are keyed by the node that ended the block before,
so a conversation of any length needs no wider row. The digests of a conversation's blocks are
chained by doubling (after round j a digest stands for 2**j blocks), so a thousand blocks take ten
rounds, not a thousand.

A node is owned by its smallest member. Along a conversation, the nodes it owns are those from
some depth on, so every node of a subtree is owned by a member of its top, and below the top by
none but members. Sums over subtrees are therefore sums over members, which a second ROLLUP
takes: of what each member's own nodes add up to, less what the top's owner has above the top.
No step walks the tree level by level.

Positions of turns come from one sort by (conv_id, turn), dealt by range, so a conversation that
holds a large part of all turns is no task's alone. Digests of members are made of runs of ids,
joined per range of a sort, which one stream per node reads in order.

Edge cases: rows without conv_id belong to no conversation and are left out. Null role or text is
empty. Turns with equal `turn` are ordered by their ids, and repeated rows are turns of their own.
Negative conv_ids share with conv_id - conv_id % 20 as SQL computes it, towards 0. An empty table
gives an empty result, without a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.buffers import discard, durable
from plumbline.llm.mixing import word_count
from plumbline.operators.ranking import placed

WIDTH = 6
SHARED = 20
HEADS = 4
RUN = 4096  # ids in a run
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(rows: DataFrame) -> DataFrame:
    """conv_id, turn, id, words of the rows that belong to a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(spelled.cast("binary"), 256)).alias("id"), word_count(text).alias("words"))


def positioned(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 0), id, words: turns in order (null first, ties by id)."""
    numbered = placed(turn_ids(rows), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")], "place")
    first = numbered.groupBy(F.col("conv_id").alias("_c")).agg(F.min("place").alias("_first"))
    joined = numbered.join(first, F.col("conv_id") == F.col("_c"))
    return joined.select("conv_id", (F.col("place") - F.col("_first")).cast("long").alias("at"), "id", "words")


def heads(turns: DataFrame, shared: int = SHARED, most: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, h, b) of every conversation and (conv_id, at, id, words) of the turns that it
    takes over: the first h of conversation conv_id - conv_id % shared, of which there are b."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % shared)
    first = turns.where((F.col("at") < most - 1) & (F.col("conv_id") % shared == 0)).select(F.col("conv_id").alias("base"), "at", "id", "words")
    sizes = first.groupBy("base").agg(F.count(F.lit(1)).alias("has"))
    known = convs.join(sizes, "base", "left").select("conv_id", "n", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("b"))
    taken = known.join(first, "base").where("at < h").select("conv_id", "at", "id", "words")
    return known.select("conv_id", "n", "h", "b"), taken


def rebuilt(turns: DataFrame, shared: int = SHARED, most: int = HEADS) -> DataFrame:
    """conv_id, length, at, id, words: the turns of each conversation after it took over the
    heads; one row with null at, id and words for a conversation without turns."""
    known, taken = heads(turns, shared, most)
    known = known.withColumn("length", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(known, "conv_id").where("at >= h").select("conv_id", "length", (F.col("at") - F.col("h") + F.col("b")).alias("at"), "id", "words")
    given = taken.join(known.select("conv_id", "length"), "conv_id").select("conv_id", "length", "at", "id", "words")
    none = known.where("length = 0").select("conv_id", "length", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("id", "binary"), ("words", "long"))])
    return own.unionAll(given).unionAll(none)


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def blocks(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, length, block, prior, after, t1..tn, w1..wn (durable): turns in positional
    columns; prior and after: digests of all turns before the block and up to its end (after is
    null where the block isn't full)."""
    at = F.coalesce(F.col("at"), F.lit(0))
    columns = [F.max(F.when(F.col("at") % width == i, F.col(c))).alias(f"{c[0]}{i + 1}".replace("i", "t")) for c in ("id", "words") for i in range(width)]
    wide = turns.groupBy("conv_id", F.floor(at / width).alias("block")).agg(F.max("length").alias("length"), *columns)
    names = [f"t{i + 1}" for i in range(width)]
    wide = durable(wide.withColumn("after", F.when(F.col(names[-1]).isNotNull(), _digest(*names))), "blocks")
    # the digest of block k stands for the blocks k - span + 1 .. k
    chain, span = durable(wide.where("after IS NOT NULL").select("conv_id", "block", "after"), "chain"), 1
    deepest = wide.agg(F.max("block")).first()[0] or 0
    while span <= deepest:
        before = chain.select("conv_id", (F.col("block") + span).alias("block"), F.col("after").alias("before"))
        longer = durable(chain.join(before, ["conv_id", "block"], "left").select("conv_id", "block", F.when(F.col("before").isNull(), F.col("after")).otherwise(_digest("before", "after")).alias("after")), "chain")
        discard(chain)
        chain, span = longer, 2 * span
    prior = chain.select("conv_id", (F.col("block") + 1).alias("block"), F.col("after").alias("prior"))
    whole = wide.drop("after").join(chain, ["conv_id", "block"], "left").join(prior, ["conv_id", "block"], "left")
    found = durable(whole.withColumn("prior", F.coalesce("prior", F.lit(b""))), "blocks")
    discard(wide)
    discard(chain)
    return found


def _names(width: int) -> list[str]:
    return [f"t{i + 1}" for i in range(width)]


def _prefix_digest(level: Column, width: int) -> Column:
    """The digest of the first `level` turns of a block and all before it; a full block's is
    `after`, and none's is `prior`."""
    names = _names(width)
    within = [F.when(level == n, _digest(F.lit(n.to_bytes(2, "big")), F.col("prior"), *names[:n])) for n in range(1, width)]
    return F.coalesce(F.when(level == 0, F.col("prior")), F.when(level == width, F.col("after")), *within)


def rolled(rows: DataFrame, aggregates: dict[str, str], width: int = WIDTH) -> DataFrame:
    """A row for each prefix in rows: block, level (turns of the block in the prefix), depth,
    prior, after, t1..tn and the aggregates. Only block 0 has a prefix of level 0, the root:
    elsewhere that is the last node of the block before."""
    names = _names(width)
    columns = ", ".join(names)
    levels = " ".join(f"WHEN {(1 << (width - n)) - 1} THEN {n}" for n in range(width + 1))
    found = rows.sparkSession.sql(
        f"""SELECT block, prior, {columns}, max(after) AS after, CASE grouping_id() {levels} END AS level,
          {', '.join(f'{sql} AS {name}' for name, sql in aggregates.items())}
        FROM {{rows}} GROUP BY block, prior, ROLLUP({columns})""",
        rows=rows,
    )
    reached = F.coalesce(F.when(F.col("level") == 0, F.col("block") == 0), *[F.when(F.col("level") == n + 1, F.col(name).isNotNull()) for n, name in enumerate(names)])
    return found.where(reached).withColumn("depth", F.col("block") * width + F.col("level"))


def nodes_of(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id (smallest member), depth, node and parent (digests), n_convs, childless, value
    (what sharing the node's last turn saves)."""
    words = {f"w{n}": f"max(w{n})" for n in range(1, width + 1)}
    found = rolled(rows, {"conv_id": "min(conv_id)", "n_convs": "count(*)", "longest": "max(length)"} | words, width)
    last = F.coalesce(F.element_at(F.array(F.lit(0).cast("long"), *words), F.col("level") + 1), F.lit(0))
    parent = F.when(F.col("level") > 0, _prefix_digest(F.col("level") - 1, width))
    return found.select("conv_id", "depth", _prefix_digest(F.col("level"), width).alias("node"), parent.alias("parent"), "n_convs", (F.col("longest") == F.col("depth")).alias("childless"), ((F.col("n_convs") - 1) * last).alias("value"))


def with_parents(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """nodes with parent_conv_id: the owner itself, but for the first node that it owns."""
    known = nodes.join(owners.select("conv_id", "first"), "conv_id")
    above = nodes.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    firsts = known.where("depth = first AND depth > 0").join(above, ["parent", "depth"]).select(*nodes.columns, "parent_conv_id")
    rest = known.where("depth <> first OR depth = 0").select(*nodes.columns, F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    return firsts.unionAll(rest)


def values_above(nodes: DataFrame, stretch: int = 4096) -> DataFrame:
    """conv_id, depth, above: the values of the nodes of the same owner nearer to the root,
    summed within stretches of depths and over the stretches before."""
    cut = nodes.select("conv_id", "depth", "value", F.floor(F.col("depth") / stretch).alias("stretch"))
    sums = cut.groupBy("conv_id", "stretch").agg(F.sum("value").alias("total"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv_id", "stretch", F.coalesce(F.sum("total").over(upto(Window.partitionBy("conv_id").orderBy("stretch"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("value").over(upto(Window.partitionBy("conv_id", "stretch").orderBy("depth"))), F.lit(0))
    return cut.withColumn("own", own).join(bases, ["conv_id", "stretch"]).select("conv_id", "depth", (F.col("base") + F.col("own")).alias("above"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (owner, depth, member) as runs of members that are joined by commas."""
    now, ids = None, []

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"owner": [now[0]], "depth": [now[1]], "begin": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        done = []
        for owner, depth, member in zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "member")), strict=True):
            if now != (owner, depth) or len(ids) >= RUN:
                if ids:
                    done.append(run())
                now, ids = (owner, depth), []
            ids.append(member)
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else []
    if ids:
        yield run()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's runs, which come one after the other."""
    now, sha = None, None
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "ids")), strict=True):
            if now != (owner, depth):
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _digests(done)
    if now:
        yield _digests([(*now, sha.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    owner, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["conv_id", "depth", "ends_sha256"])


def ends(rows: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    level = F.col("length") - F.col("block") * width
    last = rows.where((F.col("block") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / width))).select(F.col("conv_id").alias("member"), F.col("length").alias("depth"), _prefix_digest(level, width).alias("node"))
    members = last.join(nodes.select(F.col("conv_id").alias("owner"), "depth", "node"), ["depth", "node"]).select("owner", "depth", "member")
    order = ["owner", "depth", "member"]
    runs = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "owner long, depth long, begin long, ids string")
    return runs.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "begin").select("owner", "depth", "ids").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: int = SHARED, most: int = HEADS, width: int = WIDTH) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rows = blocks(rebuilt(positioned(conversations), shared, most), width)
    nodes = durable(nodes_of(rows, width), "trie")
    owners = durable(nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.sum("value").alias("total"), F.count_if("childless").alias("leaf")), "owners")
    below = rolled(rows.join(owners, "conv_id"), {"conv_id": "min(conv_id)", "total": "sum(total)", "n_leaves": "sum(leaf)"}, width).select("conv_id", "depth", "total", "n_leaves")
    known = with_parents(nodes, owners)
    children = known.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    key = ["conv_id", "depth"]
    found = known.join(below, key).join(values_above(nodes), key).join(children, key, "left").join(ends(rows, nodes, width), key, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations of `conversations`."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""WITH turns AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
  lists AS (SELECT conv_id, list(t ORDER BY i) AS l,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % {HEADS} AS h FROM turns GROUP BY conv_id),
  built AS (SELECT a.conv_id, coalesce(b.l[1:a.h], []) || a.l[a.h + 1:] AS s FROM lists a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % {SHARED}),
  nodes AS MATERIALIZED (SELECT d AS depth, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends
    FROM built, range(len(s) + 1) AS t(d) GROUP BY ALL),
  children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
  full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * (CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\\x20\\x09-\\x0D]+')) END) AS value
    FROM nodes LEFT JOIN children USING (p, depth)),
  sums AS (SELECT p[1:d] AS p, d AS depth, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM full_nodes, range(depth + 1) AS t(d) GROUP BY ALL)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s USING (p, depth) LEFT JOIN nodes up ON up.p = f.p[1:f.depth - 1] AND up.depth = f.depth - 1"""
