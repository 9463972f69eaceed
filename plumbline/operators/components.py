"""Connected components of an undirected graph as iterated joins."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that were written and not yet discarded, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset (local runs only)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-plumbline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, is computed once,
    and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.durable_path = path
    return written


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a durable frame from which nothing is left to compute."""
    _delete(df.sparkSession, df.durable_path)


@atexit.register
def _discard_all() -> None:
    """What results may still have been read from goes with the program, if Spark still runs."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc.sc().isStopped():
                continue
            _delete(spark, path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label (durable): the least label of each node's component.

    nodes: node, label (one row a node, labels unique); edges: a, b, each end in nodes, either
    direction. A round takes the least label around each node and then follows labels once
    more through the node that owns them, so a chain of n nodes needs about log n rounds, not
    n. Least labels are taken before each shuffle, too. Labels only fall, so rounds end.
    Joins are by sorting: files of labels are small for their rows, and broadcast in every round
    they would all pass through the driver.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = durable(both.unionAll(both.select("b", "a")), "edges")
    owners = durable(nodes.select("node", "label"), "labels")
    now = owners
    owned = owners.select(F.col("node").alias("owner"), F.col("label").alias("owned"))
    while True:
        around = both.join(now.select(F.col("node").alias("a"), "label").hint("merge"), "a").groupBy("b").agg(F.min("label").alias("near")).withColumnRenamed("b", "node")
        hooked = now.select("node", "label").join(around.hint("merge"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # the label's owner may know a lesser one
        roots = owned.join(hooked.select(F.col("node").alias("owner"), F.col("label").alias("root")).hint("merge"), "owner").where("root < owned").select("owned", "root")
        jumped = hooked.join(roots.hint("merge"), F.col("label") == F.col("owned"), "left").select("node", "was", F.coalesce("root", "label").alias("label"))
        new = durable(jumped, "labels")
        if now is not owners:
            discard(now)
        if new.where("label <> was").isEmpty():
            discard(both)
            discard(owners)
            found = new.select("node", "label")
            found.durable_path = new.durable_path
            return found
        now = new


def linked_components(edges: DataFrame) -> DataFrame:
    """node, label (durable) of every end of edges (a, b; numbers, either direction): label is
    the least node of its component. As connected_components, for nodes that are their own
    labels: the first round looks at edges alone, and a round that changes nothing is the
    last before labels are followed."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(edges.where("a <> b").select(F.inline(ways)).distinct(), "edges")
    near = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        owners = near.select(F.col("node").alias("label"), F.col("label").alias("root"))
        now = durable(near.select("node", "label").join(owners, "label").select("node", F.col("root").alias("label")), "labels")
        discard(near)
        told = both.join(now.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        every = told.unionAll(now.select("node", "label", F.col("label").alias("was")))
        near = durable(every.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), "labels")
        if near.where("label <> was").isEmpty():
            discard(both)
            discard(near)
            return now
        discard(now)
