"""Controls of an audit's power and noise, batched as scenarios of one job: what-if copies of
the points carry a scenario in their node's key, and the audits run over all at once."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import audit, matching
from plumbline.operators.settings import AuditConfig

MIN_CHAIN = 4
R_FACTORS, DTHETAS, DZS = (0.25, 0.35, 0.45), (3, 4, 6), (30.0, 40.0, 60.0)


def scenario_nodes(points: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Points whose nodes are told apart by their scenario."""
    return points.withColumn("nkey", F.concat_ws("#", scenario, "nkey")).withColumn("node", F.concat_ws("#", scenario, "node"))


def plant_steps(points: DataFrame, steps: tuple[int, ...] = (1, -1)) -> DataFrame:
    """Each relative chain of MIN_CHAIN points or more once a scenario: its labels raised (scenario
    1) and lowered (-1) by one after the middle; 0 leaves them."""
    chain = Window.partitionBy("nkey").orderBy("pid")
    p = points.where("kind = 'relative'").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("nkey"))).withColumn("_i", F.row_number().over(chain))
    p = p.where(F.col("_n") >= MIN_CHAIN).withColumn("scenario", F.explode(F.array(*map(F.lit, steps))))
    return p.withColumn("label", F.col("label") + F.when(F.col("_i") > F.floor(F.col("_n") / 2), F.col("scenario")).otherwise(0)).drop("_n", "_i")


def plant_sheet_switch(points: DataFrame, spacing: float) -> DataFrame:
    """As plant_steps, but the points after the middle move by one wrap's spacing in radius."""
    chain = Window.partitionBy("nkey").orderBy("pid")
    p = points.where("kind <> 'absolute'").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("nkey"))).withColumn("_i", F.row_number().over(chain))
    p = p.where(F.col("_n") >= MIN_CHAIN).withColumn("scenario", F.explode(F.array(F.lit(1), F.lit(-1))))
    return p.withColumn("r", F.col("r") + F.when(F.col("_i") > F.floor(F.col("_n") / 2), F.col("scenario") * F.lit(spacing)).otherwise(0.0)).drop("_n", "_i")


def planted_order_audit(planted: DataFrame, cfg: AuditConfig) -> DataFrame:
    """node, n_pairs, n_sign, n_split of each scenario's nodes."""
    return audit.order_audit(audit.with_slopes(scenario_nodes(planted), cfg.sense), cfg)


def planted_summary(audited: DataFrame) -> DataFrame:
    """scenario, n_trials, n_alarms, alarm_rate, mean_new: chains with more violations in a scenario
    than in scenario 0, and how many more. audited: the order audit of scenarios with 0."""
    v = audited.select(F.substring_index("node", "#", 1).cast("int").alias("scenario"), F.substring_index("node", "#", -1).alias("node"), (F.col("n_sign") + F.col("n_split")).alias("n"))
    more = v.withColumn("_new", F.col("n") - F.max(F.when(F.col("scenario") == 0, F.col("n"))).over(Window.partitionBy("node"))).where("scenario <> 0")
    alarm = F.col("_new") > 0
    rate = F.count_if(alarm) / F.count(F.lit(1))
    return more.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(alarm).alias("n_alarms"), rate.alias("alarm_rate"), F.avg(F.when(alarm, F.col("_new"))).alias("mean_new"))


def jitter(points: DataFrame, rounds: int, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    """points `rounds` times, each copy (scenario 1..rounds) with normal noise on x, y and z.
    The noise is a function of seed, round, point and axis, so reruns agree however the
    rows are dealt."""
    p = points.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(rounds))))

    def unit(*salt) -> F.Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "scenario", "pid", *map(F.lit, salt)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))

    def normal(axis: str) -> F.Column:
        return F.sqrt(-2 * F.log(unit(axis, 1))) * F.cos(F.lit(2 * math.pi) * unit(axis, 2)) * F.lit(sigma)

    p = p.withColumn("_x", F.col("r") * F.cos("theta") + normal("x")).withColumn("_y", F.col("r") * F.sin("theta") + normal("y")).withColumn("z", F.col("z") + normal("z"))
    theta = F.pmod(F.atan2("_y", "_x"), F.lit(2 * math.pi))
    return p.withColumn("r", F.hypot("_x", "_y")).withColumn("theta", theta).drop("_x", "_y")


def noise_null(points: DataFrame, cfg: AuditConfig, rounds: int, seed: int = 1) -> DataFrame:
    """scenario, n_pairs, n_violations: the order audit under noise alone."""
    p = scenario_nodes(jitter(points, rounds, seed=seed))
    v = audit.order_pairs(audit.with_slopes(p, cfg.sense), cfg)
    return v.groupBy(F.substring_index("node", "#", 1).cast("int").alias("scenario")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count("violation").alias("n_violations"))


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact confidence interval of a share, by bisection of the binomial distribution."""

    def at_least(k: int, p: float) -> float:
        if p <= 0 or p >= 1:
            return float(k <= 0 or p >= 1)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
        return min(1.0, math.fsum(map(math.exp, logs)))

    def solve(k: int, tail: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at_least(k, mid) < tail else (lo, mid)
        return lo

    tail = (1 - level) / 2
    return (0.0 if hits == 0 else solve(hits, tail)), (1.0 if hits == n else solve(hits + 1, 1 - tail))


def null_summary(null: DataFrame, base: int) -> DataFrame:
    """One row: rounds of the null, those with more violations than without noise (base), their
    share and its exact 95 % interval. null has one row a round."""
    n = null.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_violations") > base).alias("hits")).first()
    low, high = clopper_pearson(n["hits"], n["n"]) if n["n"] else (0.0, 1.0)
    share = n["hits"] / n["n"] if n["n"] else None
    return null.sparkSession.createDataFrame([(n["n"], n["hits"], share, low, high)], "n_rounds long, n_alarms long, share double, low double, high double")


def sensitivity_sweep(sloped: DataFrame, cfg: AuditConfig, factors=R_FACTORS, dthetas=DTHETAS, dzs=DZS) -> DataFrame:
    """node, robustness: the share of settings under which a node is in a conflict. Link radii
    share one search; each pair of cell sizes needs its own."""
    from plumbline.operators.components import durable

    sloped = durable(sloped, "sloped")
    widest = max(factors)
    parts = []
    for degrees in dthetas:
        for dz in dzs:
            c = replace(cfg, sector_dz=dz, sector_dtheta_rad=math.radians(degrees), r_same=widest * cfg.wrap_spacing_median)
            found = matching.links(matching.in_cells(sloped, c), c).withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
            found = found.where(F.abs("gap") <= F.col("factor") * F.lit(cfg.wrap_spacing_median))
            g = found.groupBy("factor", "a", "b", "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.min_edge_support)
            g = g.groupBy("factor", "a", "b").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
            parts.append(durable(g.select(F.explode(F.array("a", "b")).alias("node"), F.lit(f"{degrees}/{dz}").alias("cells"), "factor").distinct(), "sweep"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("node").agg((F.count(F.lit(1)) / F.lit(float(len(factors) * len(dthetas) * len(dzs)))).alias("robustness"))
