"""Audits within one node: local slopes, order of labels against radii, steps of a trace."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import label_diff, projected_gap, wrap_angle
from plumbline.operators.settings import AuditConfig

SLOPE_DZ = 60.0
SLOPE_DTHETA = math.radians(6)
SLOPE_MIN_SPAN = 10.0
STRICT_DZ = 10.0
TREND_STEPS = 3


def _within_node(points: DataFrame, dz: float, cols: list[str]) -> DataFrame:
    """Pairs of points of one node that share or neighbour a band of dz along z; the second
    point's columns end in _b."""
    a = points.withColumn("_band", F.floor(F.col("z") / F.lit(dz)))
    b = a.select("nkey", *[F.col(c).alias(c + "_b") for c in cols], F.explode(F.array(*[F.col("_band") + k for k in (-1, 0, 1)])).alias("_band"))
    # b has three rows a point: more than is known of the points' files, so it mustn't be broadcast
    return a.join(b.hint("merge"), ["nkey", "_band"])


def _near(dz: float, dtheta: float) -> Column:
    return (F.abs(F.col("z") - F.col("z_b")) <= F.lit(dz)) & (F.abs(wrap_angle(F.col("theta") - F.col("theta_b"))) <= F.lit(dtheta))


def with_slopes(points: DataFrame, sense: int = 1) -> DataFrame:
    """points with slope: dr/dz by least squares over the point's own sheet nearby, null where
    that is too short along z."""
    pairs = _within_node(points.select("nkey", "pid", "theta", "r", "z", "label"), SLOPE_DZ, ["theta", "r", "z", "label"])
    same = label_diff(F.col("label"), F.col("theta"), F.col("label_b"), F.col("theta_b"), sense) == 0
    # a point has one band, so groups lie where the join left them, and few points have a slope
    own = pairs.where(_near(SLOPE_DZ, SLOPE_DTHETA) & same).groupBy("nkey", "_band", "pid")
    s = own.agg(F.when((F.count(F.lit(1)) >= 2) & (F.max("z_b") - F.min("z_b") >= SLOPE_MIN_SPAN), F.regr_slope("r_b", "z_b")).alias("slope"))
    return points.join(s.where("slope is not null").select("nkey", "pid", "slope"), ["nkey", "pid"], "left")


def order_pairs(sloped: DataFrame, cfg: AuditConfig, kinds: tuple[str, ...] = ("relative", "absolute")) -> DataFrame:
    """Tested pairs of one node: pid_a, pid_b, d_label, gap, violation ('sign', 'split' or null).
    The radii of a pair must be in the order of its labels; equal labels mustn't be a
    wrap apart."""
    p = sloped.where(F.col("kind").isin(*kinds) & F.col("seam_safe")).select("nkey", "node", "pid", "theta", "r", "z", "label", "slope")
    pairs = _within_node(p, cfg.sector_dz, ["pid", "theta", "r", "z", "label", "slope"]).where((F.col("pid") < F.col("pid_b")) & _near(cfg.sector_dz, cfg.sector_dtheta_rad))
    side = lambda s: {c: F.col(c + s) for c in ("r", "z", "slope")}
    pairs = pairs.withColumn("gap", projected_gap(side(""), side("_b"), STRICT_DZ)).where("gap is not null")
    d = label_diff(F.col("label"), F.col("theta"), F.col("label_b"), F.col("theta_b"), cfg.sense)
    pairs = pairs.withColumn("d_label", d)
    kind = F.when(F.col("d_label") == 0, F.when(F.abs("gap") > cfg.crowd_min_spacing, "split")).when((F.col("d_label") * F.col("gap") < 0) & (F.abs("gap") > cfg.r_same), "sign")
    return pairs.select("node", F.col("pid").alias("pid_a"), "pid_b", "d_label", "gap", kind.alias("violation"))


def order_audit(sloped: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Per node with tested pairs: n_pairs, n_sign, n_split."""
    v = order_pairs(sloped, cfg)
    return v.groupBy("node").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("violation") == "sign").alias("n_sign"), F.count_if(F.col("violation") == "split").alias("n_split"))


def shuffled_order_control(sloped: DataFrame, cfg: AuditConfig, rounds: int, seed: int = 1) -> DataFrame:
    """round, n_pairs, rate: the order audit with labels permuted within each relative node, all
    rounds in one job. Round 0 keeps the labels."""
    base = sloped.where("kind = 'relative' and seam_safe")
    r = base.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    drawn = Window.partitionBy("nkey", "round").orderBy(F.xxhash64(F.lit(seed), "round", "nkey", "pid"), "pid")
    own = Window.partitionBy("nkey", "round").orderBy("pid")
    r = r.withColumn("_draw", F.row_number().over(drawn)).withColumn("_own", F.row_number().over(own))
    labels = r.select("nkey", "round", F.col("_draw").alias("_own"), F.col("label").alias("_new"))
    r = r.join(labels, ["nkey", "round", "_own"]).withColumn("label", F.when(F.col("round") == 0, F.col("label")).otherwise(F.col("_new")))
    rounds_as_nodes = r.withColumn("node", F.col("round").cast("string")).withColumn("nkey", F.concat_ws("#", "round", "nkey"))
    v = order_pairs(rounds_as_nodes.drop("_draw", "_own", "_new"), cfg, ("relative",))
    return v.groupBy(F.col("node").cast("int").alias("round")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("violation").isNotNull().cast("double")).alias("rate"))


def step_audit(points: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Tested steps of same-sheet traces: residual against the median slope of up to three
    steps on either side, and whether it exceeds the crowding floor."""
    chain = Window.partitionBy("nkey").orderBy("pid")
    t = points.where("kind = 'same'").select("nkey", "node", "pid", "r", "z")
    t = t.withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy("nkey")))
    for c in ("pid", "r", "z"):
        t = t.withColumn(c + "_b", F.lead(c).over(chain))
    t = t.where("pid_b is not null and n_points >= 4").withColumn("dr", F.col("r_b") - F.col("r")).withColumn("dz", F.col("z_b") - F.col("z"))
    t = t.withColumn("_slope", F.when(F.abs("dz") >= 1, F.col("dr") / F.col("dz")))
    around = lambda a, b: F.collect_list("_slope").over(chain.rowsBetween(a, b))
    t = t.withColumn("_near", F.sort_array(F.concat(around(-TREND_STEPS, -1), around(1, TREND_STEPS))))
    t = t.where((F.abs("dz") >= 1) & (F.size("_near") > 0))
    n = F.size("_near")
    middle = (F.element_at("_near", F.floor((n + 1) / 2).cast("int")) + F.element_at("_near", (F.floor(n / 2) + 1).cast("int"))) / 2
    t = t.withColumn("residual", F.col("dr") - middle * F.col("dz"))
    return t.select("node", F.col("pid").alias("pid_a"), "pid_b", "residual", (F.abs("residual") > cfg.crowd_min_spacing).alias("violation"))
