"""From points to nodes: axis frame, chains with their crossings, angular clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import TWO_PI, cut_crossing, cylindrical, node_key, node_tag, wrap_angle

MAX_STEP = math.radians(120)
CLUSTER_GAP = math.radians(8)
CUT_GUARD = math.radians(10)


def axis_segments(axis: DataFrame, clamp: bool = True) -> DataFrame:
    """z0, z1, x0, x1, y0, y1 and the range lo..hi of z each segment serves. With clamp, places
    beyond the ends take the end's value; otherwise the end segments are carried on. The
    axis is a small parameter table (hundreds of control points)."""
    w = Window.orderBy("z")
    lead = lambda c: F.lead(c).over(w)
    s = axis.select(F.col("z").alias("z0"), lead("z").alias("z1"), F.col("x").alias("x0"), lead("x").alias("x1"), F.col("y").alias("y0"), lead("y").alias("y1")).where("z1 is not null")
    ends = Window.partitionBy()
    s = s.withColumn("lo", F.when(F.col("z0") == F.min("z0").over(ends), F.lit(float("-inf"))).otherwise(F.col("z0")))
    s = s.withColumn("hi", F.when(F.col("z1") == F.max("z1").over(ends), F.lit(float("inf"))).otherwise(F.col("z1")))
    return s.withColumn("clamp", F.lit(clamp))


def place_on_axis(points: DataFrame, axis: DataFrame, clamp: bool = True) -> DataFrame:
    """points (x, y, z, ...) with axis_x, axis_y by linear interpolation in z.

    The segments become one array literal's worth of rows, collected into a single-row
    frame, so the lookup is a filter over a short array and the points aren't shuffled."""
    table = axis_segments(axis, clamp).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "z0", "z1", "x0", "x1", "y0", "y1"))).alias("_axis"))
    joined = points.crossJoin(F.broadcast(table))  # one row of a parameter table
    seg = F.element_at(F.filter("_axis", lambda s: (F.col("z") >= s["lo"]) & (F.col("z") < s["hi"])), 1)
    joined = joined.withColumn("_s", seg)
    zz = F.greatest(F.col("_s.z0"), F.least(F.col("_s.z1"), F.col("z"))) if clamp else F.col("z")
    part = (zz - F.col("_s.z0")) / (F.col("_s.z1") - F.col("_s.z0"))
    out = joined.withColumn("axis_x", F.col("_s.x0") + part * (F.col("_s.x1") - F.col("_s.x0"))).withColumn("axis_y", F.col("_s.y0") + part * (F.col("_s.y1") - F.col("_s.y0")))
    return out.drop("_axis", "_s")


def to_cylindrical(points: DataFrame, axis: DataFrame, clamp: bool = True) -> DataFrame:
    """points with axis_x, axis_y, r and theta."""
    placed = place_on_axis(points, axis, clamp)
    r, theta = cylindrical(F.col("x"), F.col("y"), F.col("axis_x"), F.col("axis_y"))
    return placed.withColumn("r", r).withColumn("theta", theta)


def axis_angles(points: DataFrame, axis: DataFrame, clamp: bool = True) -> DataFrame:
    """points with axis_x, axis_y and theta in single precision. A point on the axis or without a
    finite place has no angle and fails the job."""
    t = to_cylindrical(points, axis, clamp)
    undefined = F.raise_error(F.concat(F.lit("no angle on the axis at z = "), F.coalesce(F.col("z").cast("string"), F.lit("null")))).cast("double")
    return t.withColumn("theta", F.when((F.col("r") > 0) & (F.col("r") < float("inf")), F.col("theta")).otherwise(undefined).cast("float")).drop("r")


def normalise_annotations(points: DataFrame) -> DataFrame:
    """Collections without any annotation get wind_a 0; from others the points without one
    go. has_annotations tells what a collection had before."""
    w = Window.partitionBy("cid")
    marked = points.withColumn("has_annotations", F.max(F.col("wind_a").isNotNull()).over(w))
    return marked.where(~F.col("has_annotations") | F.col("wind_a").isNotNull()).withColumn("wind_a", F.coalesce("wind_a", F.lit(0.0)))


def classify(points: DataFrame, absolute: str = "is_absolute") -> DataFrame:
    """cid, kind: absolute by metadata, else relative if a point is annotated, else same."""
    by = points.groupBy("cid").agg(F.max(absolute).alias("a"), F.max(F.col("wind_a").isNotNull()).alias("w"), F.count(F.lit(1)).alias("n_points"))
    return by.select("cid", F.when(F.col("a"), "absolute").when(F.col("w"), "relative").otherwise("same").alias("kind"), "n_points")


def chain_nodes(points: DataFrame, sense: int = 1, max_step: float = MAX_STEP) -> DataFrame:
    """Relative and same collections as nodes: each point's crossings so far along its chain
    (in pid order), its label, and whether no step of the chain exceeds max_step."""
    chains = points.where("kind = 'same' or (kind = 'relative' and wind_a is not null)")
    w = Window.partitionBy("kind", "cid").orderBy("pid")
    step = chains.withColumn("_before", F.lag("theta").over(w))
    step = step.withColumn("_cut", F.when(F.col("_before").isNull(), 0).otherwise(cut_crossing(F.col("_before"), F.col("theta"))))
    step = step.withColumn("_wide", F.coalesce(F.abs(wrap_angle(F.col("theta") - F.col("_before"))) > F.lit(max_step), F.lit(False)))
    out = step.withColumn("crossings", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("seam_safe", ~F.max("_wide").over(Window.partitionBy("kind", "cid")))
    wind = F.when(F.col("kind") == "relative", F.bround("wind_a")).otherwise(F.lit(0.0)).cast("long")
    return out.withColumn("label", wind + F.lit(sense) * F.col("crossings")).withColumn("cid", F.col("cid").cast("string")).drop("_before", "_cut", "_wide")


def absolute_nodes(points: DataFrame, gap: float = CLUSTER_GAP, guard: float = CUT_GUARD) -> DataFrame:
    """Absolute collections split into angular clusters: the circle opens at its widest gap
    (the first in order of angle), and a gap over `gap` starts a new cluster."""
    pts = points.where("kind = 'absolute' and wind_a is not null")
    by = Window.partitionBy("cid").orderBy("theta", "pid")
    every = Window.partitionBy("cid")
    ahead = lambda a, b: F.pmod(b - a, F.lit(TWO_PI))
    g = pts.withColumn("_n", F.row_number().over(by)).withColumn("_before", F.lag("theta").over(by)).withColumn("_after", F.lead("theta").over(by))
    g = g.withColumn("_breaks", F.sum(F.coalesce(ahead(F.col("_before"), F.col("theta")) > F.lit(gap), F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = {"_first": F.min("theta").over(every), "_last": F.max("theta").over(every), "_most": F.max("_breaks").over(every)}
    g = g.withColumns(ends)
    around = ahead(F.col("_last"), F.col("_first"))
    to_next = F.when(F.col("_after").isNull(), around).otherwise(ahead(F.col("theta"), F.col("_after")))
    # what follows the widest gap comes first; breaks are counted on from there, round the circle
    widest = F.max(F.struct(to_next.alias("gap"), (-F.col("_n")).alias("n"), F.col("_breaks").alias("breaks"), F.col("_after").isNull().alias("end"))).over(every)
    g = g.withColumn("_open", widest)
    start = F.when(F.col("_open.end"), F.lit(0)).otherwise(F.col("_open.breaks") + (F.col("_open.gap") > F.lit(gap)).cast("int"))
    later = F.col("_open.end") | (F.col("_n") > -F.col("_open.n"))
    g = g.withColumn("_k", F.when(later, F.col("_breaks") - start).otherwise(F.col("_most") - start + (around > F.lit(gap)).cast("int") + F.col("_breaks")))
    near = F.least("theta", F.lit(TWO_PI) - F.col("theta")) < F.lit(guard)
    g = g.withColumn("seam_safe", ~F.max(near).over(Window.partitionBy("cid", "_k")))
    out = g.withColumn("cid", F.concat_ws(".", "cid", "_k")).withColumn("crossings", F.lit(0).cast("long")).withColumn("label", F.bround("wind_a").cast("long"))
    return out.select(*[c for c in points.columns], "crossings", "seam_safe", "label")


def node_points(points: DataFrame, sense: int = 1, max_step: float = MAX_STEP) -> DataFrame:
    """All points that belong to nodes, with node (its tag), nkey (sorts like the node),
    crossings, label and seam_safe."""
    cols = [*points.columns, "crossings", "seam_safe", "label"]
    both = chain_nodes(points, sense, max_step).select(*cols).unionByName(absolute_nodes(points).select(*cols))
    return both.withColumn("node", node_tag(F.col("kind"), F.col("cid"))).withColumn("nkey", node_key(F.col("kind"), F.col("cid")))


NODES_SQL = """
steps AS (SELECT *, lag(theta) OVER w AS before FROM points WHERE kind = 'same' OR (kind = 'relative' AND wind_a IS NOT NULL) WINDOW w AS (PARTITION BY kind, cid ORDER BY pid)),
cuts AS (SELECT *, CASE WHEN theta - before < -pi() THEN 1 WHEN theta - before > pi() THEN -1 ELSE 0 END AS cut,
  coalesce(abs((theta - before) - 2 * pi() * ceil(((theta - before) - pi()) / (2 * pi()))) > 2.0943951023931953e0, false) AS wide FROM steps),
chains AS (SELECT kind, CAST(cid AS VARCHAR) AS cid, pid, theta, r, z, wind_a, CAST(sum(cut) OVER (PARTITION BY kind, cid ORDER BY pid) AS BIGINT) AS crossings,
  NOT max(wide) OVER (PARTITION BY kind, cid) AS seam_safe, cid AS source_cid FROM cuts),
angles AS (SELECT *, row_number() OVER w AS n, coalesce(lead(theta) OVER w, first_value(theta) OVER (PARTITION BY cid ORDER BY theta, pid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt,
  count(*) OVER (PARTITION BY cid) AS cnt FROM points WHERE kind = 'absolute' WINDOW w AS (PARTITION BY cid ORDER BY theta, pid)),
gaps AS (SELECT *, CASE WHEN nxt - theta < 0 THEN nxt - theta + 2 * pi() ELSE nxt - theta END AS gap FROM angles),
opened AS (SELECT *, first_value(n) OVER (PARTITION BY cid ORDER BY gap DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening FROM gaps),
placed AS (SELECT *, (n - opening - 1 + cnt) % cnt AS spot FROM opened),
broken AS (SELECT *, CASE WHEN spot > 0 AND (CASE WHEN theta < lag(theta) OVER w THEN theta - lag(theta) OVER w + 2 * pi() ELSE theta - lag(theta) OVER w END) > 1.3962634015954636e-1 THEN 1 ELSE 0 END AS brk FROM placed WINDOW w AS (PARTITION BY cid ORDER BY spot)),
clusters AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY cid ORDER BY spot) AS BIGINT) AS k FROM broken),
np AS (SELECT kind, cid, pid, theta, r, z, wind_a, crossings, seam_safe, CAST(CASE WHEN kind = 'relative' THEN wind_a ELSE 0 END AS BIGINT) + crossings AS label,
  kind || ':' || cid AS node, kind || ':' || lpad(cid, 19, '0') AS nkey FROM chains
  UNION ALL SELECT kind, cid || '.' || k, pid, theta, r, z, wind_a, 0, NOT max(least(theta, 2 * pi() - theta) < 1.7453292519943295e-1) OVER (PARTITION BY cid, k), CAST(wind_a AS BIGINT),
  kind || ':' || cid || '.' || k, kind || ':' || cid || '.' || k FROM clusters)
"""
