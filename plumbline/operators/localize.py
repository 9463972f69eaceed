"""From findings to a review queue of places to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import placed


def conflict_brackets(links: DataFrame, conflicts: DataFrame, points: DataFrame) -> DataFrame:
    """For each end of a conflict the two least offsets its points imply, with the outermost
    point of the first and the innermost of the second: node, partner, offset_1, offset_2,
    pid_1, pid_2. The disagreement arises between them."""
    kept = conflicts.select("akey", "bkey", F.explode("offsets").alias("offset"))
    own = links.join(kept, ["akey", "bkey", "offset"])
    ends = own.select(F.col("a").alias("node"), F.col("b").alias("partner"), F.col("pid_a").alias("pid"), "offset").unionAll(own.select("b", "a", "pid_b", -F.col("offset")))
    ends = ends.join(points.select("node", "pid", "r"), ["node", "pid"])
    # ties go to the smaller pid
    g = ends.groupBy("node", "partner", "offset").agg(F.max(F.struct("r", -F.col("pid"))).alias("outer"), F.min(F.struct("r", "pid")).alias("inner"))
    by = Window.partitionBy("node", "partner").orderBy("offset")
    g = g.withColumn("_i", F.row_number().over(by)).withColumn("offset_2", F.lead("offset").over(by)).withColumn("_next", F.lead("inner").over(by))
    return g.where("_i = 1 and offset_2 is not null").select("node", "partner", F.col("offset").alias("offset_1"), "offset_2", (-F.col("outer.col2")).alias("pid_1"), F.col("_next.pid").alias("pid_2"))


def review_queue(conflicts: DataFrame, steps: DataFrame, quarantined: DataFrame, robustness: DataFrame, points: DataFrame) -> DataFrame:
    """node, n_points, evidence (sorted), robustness, in_quarantine, place in the queue: robust
    findings first, then those in the quarantine, then by name. conflicts: a, b, offsets;
    steps: node; quarantined: node; robustness: node, robustness."""
    text = F.concat(F.lit("links to "), F.col("other"), F.lit(" imply offsets "), F.array_join("offsets", ","))
    c = conflicts.select(F.col("a").alias("node"), F.col("b").alias("other"), "offsets").unionAll(conflicts.select("b", "a", "offsets")).select("node", text.alias("evidence"))
    s = steps.select("node", F.lit("radial step of a wrap against the trace's trend").alias("evidence"))
    q = quarantined.select("node", F.lit("member of the exact minimum quarantine").alias("evidence"))
    e = c.unionAll(s).unionAll(q).groupBy("node").agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))
    e = e.join(points.groupBy("node").agg(F.count(F.lit(1)).alias("n_points")), "node")
    e = e.join(robustness, "node", "left").join(quarantined.select("node", F.lit(True).alias("in_quarantine")).distinct(), "node", "left")
    e = e.withColumn("robustness", F.round(F.coalesce("robustness", F.lit(0.0)), 4)).withColumn("in_quarantine", F.coalesce("in_quarantine", F.lit(False)))
    return placed(e, [F.col("robustness").desc(), F.col("in_quarantine").desc(), F.col("node")], "place")
