"""The frozen configuration of an audit and its calibration from trusted anchors."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import sense_sign, wrap_angle
from plumbline.operators.components import durable


@dataclass(frozen=True)
class AuditConfig:
    wrap_spacing_median: float
    wrap_spacing_p10: float
    wrap_spacing_p90: float
    n_calibration_pairs: int
    anchor_order_agreement: float
    r_same: float
    crowd_min_spacing: float
    sector_dz: float = 40.0
    sector_dtheta_rad: float = math.radians(4)
    max_chain_step_rad: float = math.radians(120)
    min_edge_support: int = 2
    spiral_sense: str = "CW"

    @property
    def sense(self) -> int:
        return sense_sign(self.spiral_sense)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


#: For the helix fixture.
FIXTURE = AuditConfig(20.0, 18.0, 22.0, 100, 1.0, 7.0, 14.0, sector_dz=10.0)

CALIB_DZ = 200.0
CALIB_DTHETA = math.radians(8)
MIN_PAIRS = 10
SAME_FACTOR, CROWD_FACTOR = 0.35, 0.70


def anchor_pairs(points: DataFrame, dz: float = CALIB_DZ, dtheta: float = CALIB_DTHETA) -> DataFrame:
    """Pairs of absolute places close in z and angle with different labels: spacing (radial
    distance per wrap), agrees, and n, the pairs of points there. Points that share place and
    label are one place, however many they are. Places meet through cells of dz by dtheta and
    their neighbours, so no pair is looked for over the whole table."""
    cells = max(1, int(2 * math.pi / dtheta))
    place = ["theta", "r", "z", "wind_a"]
    a = points.where("kind = 'absolute'").groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    a = a.withColumn("zc", F.floor(F.col("z") / dz)).withColumn("tc", F.pmod(F.floor(F.col("theta") / F.lit(2 * math.pi) * cells), F.lit(cells)))
    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in sorted({k % cells for k in (-1, 0, 1)})]
    b = a.withColumn("_n", F.explode(F.array(*near)))
    b = b.select(*[F.col(c).alias(c + "_b") for c in (*place, "n")], (F.col("zc") + F.col("_n.i")).alias("zc"), F.pmod(F.col("tc") + F.col("_n.j"), F.lit(cells)).alias("tc"))
    close = (F.abs(F.col("z") - F.col("z_b")) <= dz) & (F.abs(wrap_angle(F.col("theta") - F.col("theta_b"))) <= F.lit(dtheta))
    dr, dw = F.col("r") - F.col("r_b"), F.col("wind_a") - F.col("wind_a_b")
    once = F.struct(*place) < F.struct(*[F.col(c + "_b").alias(c) for c in place])
    pairs = a.join(b.hint("merge"), ["zc", "tc"]).where(once & close & (dw != 0))
    return pairs.select((F.abs(dr) / F.abs(dw)).alias("spacing"), (dr * dw > 0).alias("agrees"), (F.col("n") * F.col("n_b")).alias("n"))


def quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each of the shares: the quantile (linear interpolation) of value (0 or
    more), each taken n times; null if there are none. Values are counted in bins of a hundredth
    of their size, and only those of the bins that a quantile lies in are put in order."""
    binned = values.withColumn("bin", F.floor(F.log(F.col("value") + F.lit(1e-9)) * 100))
    upto = Window.orderBy("bin")  # a few thousand bins
    counted = binned.groupBy("bin").agg(F.sum("n").alias("held")).withColumn("before", F.sum("held").over(upto) - F.col("held"))
    counted = counted.withColumn("total", F.sum("held").over(Window.partitionBy()))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ask = F.array(*[F.struct(F.lit(name).alias("name"), place(p).alias("place"), end(place(p)).cast("long").alias("rank")) for name, p in shares.items() for end in (F.floor, F.ceil)])
    asked = counted.select("bin", "before", "held", F.inline(ask)).where("rank >= before and rank < before + held").distinct()
    inside = binned.join(F.broadcast(asked.select("bin", "before").distinct()), "bin")  # six bins at most
    passed = F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("value"))
    ranked = inside.withColumn("past", passed).select("bin", "value", "past", (F.col("past") - F.col("n")).alias("first"))
    found = ranked.join(F.broadcast(asked.select("bin", "name", "place", "rank")), "bin").where("rank >= first and rank < past")
    share = F.greatest(1 - F.abs(F.col("rank") - F.col("place")), F.lit(0.0))
    return found.agg(*[F.sum(F.when(F.col("name") == name, share * F.col("value"))).alias(name) for name in shares])


def calibration(points: DataFrame, dz: float = CALIB_DZ, dtheta: float = CALIB_DTHETA) -> DataFrame:
    """One row: spacing median, p10, p90 (linear interpolation), pairs, agreement."""
    p = anchor_pairs(points, dz, dtheta).groupBy(F.col("spacing").alias("value")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("agrees"), F.col("n"))).alias("agreeing"))
    p = durable(p, "spacings")
    q = quantiles(p.select("value", "n"), {"wrap_spacing_median": 0.5, "wrap_spacing_p10": 0.1, "wrap_spacing_p90": 0.9})
    agreement = F.coalesce(F.sum("agreeing"), F.lit(0)) / F.sum("n")
    return q.join(p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_calibration_pairs"), agreement.alias("anchor_order_agreement")))  # one row each


def calibrate(points: DataFrame, sense: str = "CW", dz: float = CALIB_DZ, dtheta: float = CALIB_DTHETA) -> AuditConfig:
    """Thresholds from trusted anchors; the rest of an audit takes them as constants."""
    c = calibration(points, dz, dtheta).first()
    if c["n_calibration_pairs"] < MIN_PAIRS:
        raise ValueError(f"calibration needs {MIN_PAIRS} anchor pairs, found {c['n_calibration_pairs']}")
    sense_sign(sense)
    m = c["wrap_spacing_median"]
    return AuditConfig(m, c["wrap_spacing_p10"], c["wrap_spacing_p90"], c["n_calibration_pairs"], c["anchor_order_agreement"], SAME_FACTOR * m, CROWD_FACTOR * m, spiral_sense=sense.upper())
