"""Edges between patches as measured on the surfaces: what the trace counts, what lies between its
points and the surface, and the strips across both patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import cut_crossing
from plumbline.operators.components import discard, durable
from plumbline.operators.frame import to_cylindrical
from plumbline.operators.patches import path_transport, strip_samples


def _place(patch: str, i: str, j: str) -> Column:
    return F.concat_ws("/", patch, F.col(i).cast("string"), F.col(j).cast("string"))


def strip_ends(requests: DataFrame, quad_table: DataFrame, axis: DataFrame) -> DataFrame:
    """request, strip, end_theta: the crossings along the way between two places, and the angle of
    its last sample on the patch; null where the way can't be measured."""
    samples = durable(strip_samples(requests, quad_table), "samples")
    moved = path_transport(samples, axis).select("line_id", F.col("delta").alias("strip"))
    last = samples.where("valid").groupBy("line_id").agg(F.max_by(F.struct("x", "y", "z"), "k").alias("m")).select("line_id", "m.*")
    ends = to_cylindrical(last, axis).select("line_id", F.col("theta").alias("end_theta"))
    found = moved.where("strip IS NOT NULL").join(ends, "line_id")
    return requests.select("request").join(found.withColumnRenamed("line_id", "request"), "request", "left")


def measured_edges(edges: DataFrame, entries: DataFrame, quad_table: DataFrame, axis: DataFrame, gaps: bool = True) -> DataFrame:
    """edges with strip_from, strip_to, gap_from, gap_to and measured: delta, the gaps at both
    ends, and the strips from the patches' entries to where the edge leaves and comes in.

    edges: from_patch, to_patch, delta; from_i, from_j, to_i, to_j (places on the patches); fx, fy,
    fz, tx, ty, tz (the trace's points there). entries: patch_id, i, j. A gap is the crossing
    between the last sample of a strip and the trace's point, which neither the strip nor the
    trace counts; without gaps both are 0. measured is null where a strip can't be
    measured. Ways to one place of a patch are looked for once."""
    at = entries.select(F.col("patch_id"), F.col("i").cast("double").alias("from_i"), F.col("j").cast("double").alias("from_j"))
    named = edges.withColumn("_f", _place("from_patch", "from_i", "from_j")).withColumn("_t", _place("to_patch", "to_i", "to_j"))
    ask = lambda patch, i, j, name: F.struct(F.col(name).alias("request"), F.col(patch).alias("patch_id"), F.col(i).cast("double").alias("to_i"), F.col(j).cast("double").alias("to_j"))
    asked = named.select(F.inline(F.array(ask("from_patch", "from_i", "from_j", "_f"), ask("to_patch", "to_i", "to_j", "_t")))).distinct()
    requests = durable(asked.join(at, "patch_id").select("request", "patch_id", "from_i", "from_j", "to_i", "to_j"), "requests")
    ends = durable(strip_ends(requests, quad_table, axis), "ends")
    side = lambda name, s: ends.select(F.col("request").alias(name), F.col("strip").alias(f"strip_{s}"), F.col("end_theta").alias(f"_end_{s}"))
    both = named.join(side("_f", "from"), "_f", "left").join(side("_t", "to"), "_t", "left")
    for s in "ft":
        placed = both.select(*[c for c in both.columns if c not in "xyz"], F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"), F.col(f"{s}z").alias("z"))
        both = to_cylindrical(placed, axis).withColumnRenamed("theta", f"_theta_{s}").drop("x", "y", "z", "axis_x", "axis_y", "r")
    known = F.col("_end_from").isNotNull() & F.col("_end_to").isNotNull()
    gap = lambda p, q: F.when(known & F.lit(gaps), cut_crossing(F.col(p), F.col(q))).otherwise(0)
    both = both.withColumn("gap_from", gap("_end_from", "_theta_f")).withColumn("gap_to", gap("_theta_t", "_end_to"))
    whole = F.col("delta") + F.col("gap_from") + F.col("gap_to") + F.col("strip_from") - F.col("strip_to")
    return both.withColumn("measured", whole.cast("long")).select(*edges.columns, "strip_from", "strip_to", "gap_from", "gap_to", "measured")


def shifted_windings(reached: DataFrame, changes: DataFrame) -> DataFrame:
    """reached (patch_id, via, winding, ...) after the edges by which patches were reached changed
    (patch_id, change): the same tree, and windings only of what lies behind changed edges
    differ. Changes are added up by doubling strides towards the roots."""
    own = reached.join(changes.groupBy("patch_id").agg(F.sum("change").alias("change")), "patch_id", "left")
    now = durable(own.select("patch_id", F.col("via").alias("up"), F.coalesce("change", F.lit(0)).cast("long").alias("sum")), "shifts")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("patch_id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("more"))
        new = durable(now.join(above, "up", "left").select("patch_id", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")), "shifts")
        discard(now)
        now = new
    return reached.join(now.select("patch_id", "sum"), "patch_id").withColumn("winding", F.col("winding") + F.col("sum")).select(reached.columns)
