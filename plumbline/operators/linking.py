"""Which patch a point is linked to: hits gated by their neighbours on the trace, sides, named
pairs and policies; and what new patches add to links that were made before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("nearest", "largest_area")
SIDES = ("front", "behind")


def chain_places(points: DataFrame) -> DataFrame:
    """points (cid, pid, ...) with at and members: the place along the trace and its length."""
    by = Window.partitionBy("cid")
    return points.withColumn("at", F.row_number().over(by.orderBy("pid"))).withColumn("members", F.count(F.lit(1)).over(by))


def gated_hits(points: DataFrame, hits: DataFrame, window: int, least: int) -> DataFrame:
    """The hits (pid, patch_id, ...) whose patch is hit by `least` points of the window around the
    point, itself included; at a trace's ends by all of fewer. Each patch is gated by its own
    hits: a hit's window holds only rows of its patch, so a trace isn't crossed with patches."""
    half = window // 2
    placed = hits.join(chain_places(points).select("cid", "pid", "at", "members"), "pid")
    near = Window.partitionBy("cid", "patch_id").orderBy("at").rangeBetween(-half, half)
    held = F.least(F.col("at") + half, F.col("members")) - F.greatest(F.col("at") - half, F.lit(1)) + 1
    return placed.where(held > 0).withColumn("_n", F.count(F.lit(1)).over(near)).where(F.col("_n") >= F.least(F.lit(least), held)).select(*hits.columns)


def on_side(hits: DataFrame, rule: str, margin: float) -> DataFrame:
    """The hits (ax, ay, az: from the point to its foot on the patch; ix, iy, iz: inward there) that
    the rule allows: 'front' asks for a foot no more than margin outward of the point, 'behind'
    for one no more than margin inward. Where the foot or the direction isn't known none is
    refused."""
    if rule not in SIDES:
        raise ValueError(f"{rule} is none of {SIDES}")
    inward = F.col("ax") * F.col("ix") + F.col("ay") * F.col("iy") + F.col("az") * F.col("iz")
    known = inward.isNotNull() & ~F.isnan(inward) & ((F.col("ix") != 0) | (F.col("iy") != 0) | (F.col("iz") != 0))
    wrong = inward < -margin if rule == "front" else inward > margin
    return hits.where(~F.coalesce(known & wrong, F.lit(False)))


def _first(policy: str | Column) -> Column:
    largest = policy if isinstance(policy, Column) else F.lit(policy == "largest_area")
    return F.struct(F.when(largest, -F.coalesce("area", F.lit(0.0))).otherwise(F.lit(0.0)).alias("rank"), "distance", "patch_id")


def chosen_links(points: DataFrame, hits: DataFrame, areas: DataFrame, pairs: DataFrame | None = None, policy: str = "nearest", window: int = 1, least: int = 1) -> DataFrame:
    """pid, patch_id, distance: one hit of each point that has no patch yet.

    points: cid, pid, patch_id (null: none yet), and name where pairs are given; hits: pid,
    patch_id, distance; areas: patch_id, area. Points that have a patch count in windows, and keep
    it. Traces whose name is in pairs (name, first, second) are linked to those two patches
    only, always the nearest; others by the policy. Ties go to the nearer, then the lesser
    patch_id."""
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {POLICIES}")
    asked = hits.select("pid", "patch_id", "distance")
    named = points.select("pid", F.lit(False).alias("paired")) if pairs is None else None
    if pairs is not None:
        own = points.join(pairs, "name", "left").select("pid", F.col("first").isNotNull().alias("paired"), "first", "second")
        allowed = ~F.col("paired") | (F.col("patch_id") == F.col("first")) | (F.col("patch_id") == F.col("second"))
        asked = asked.join(own, "pid").where(allowed).select("pid", "patch_id", "distance")
        named = own.select("pid", "paired")
    fair = gated_hits(points, asked, window, least) if least > 1 else asked
    open_ = fair.join(points.where("patch_id IS NULL").select("pid"), "pid", "left_semi").join(named, "pid")
    ranked = open_.join(areas.select("patch_id", "area"), "patch_id", "left")
    best = F.min(_first(~F.col("paired") & F.lit(policy == "largest_area"))).alias("m")
    return ranked.groupBy("pid").agg(best).select("pid", "m.patch_id", "m.distance")


def linked_points(points: DataFrame, links: DataFrame) -> DataFrame:
    """points with the links' patches where they had none."""
    new = links.select("pid", F.col("patch_id").alias("_new"))
    return points.join(new, "pid", "left").withColumn("patch_id", F.coalesce("patch_id", "_new")).drop("_new").select(points.columns)


def link_new_patches(points: DataFrame, new_hits: DataFrame, areas: DataFrame, pairs: DataFrame | None = None, policy: str = "nearest", window: int = 1, least: int = 1) -> DataFrame:
    """chosen_links of what new patches offer: new_hits are hits of all points on the new patches
    alone, and only windows that hold one of them are looked at. Of absolute traces (absolute,
    wind_a) only points with a winding above 0 are offered or counted. A point that has none
    was refused by every earlier patch, and a patch's gate depends on its own hits; so the
    links are those of linking everything again, as long as those made before stay."""
    offered = points.where(~F.coalesce("absolute", F.lit(False)) | F.coalesce((F.col("wind_a") > 0) & ~F.isnan("wind_a"), F.lit(False)) | F.col("patch_id").isNotNull())
    touched = new_hits.join(points.select("pid", "cid"), "pid").select("cid").distinct()
    return chosen_links(offered.join(touched, "cid", "left_semi"), new_hits, areas, pairs, policy, window, least)


def gains(points: DataFrame, links: DataFrame) -> DataFrame:
    """cid, gained: newly linked points of each trace that has any."""
    return links.join(points.select("pid", "cid"), "pid").groupBy("cid").agg(F.count(F.lit(1)).alias("gained"))
