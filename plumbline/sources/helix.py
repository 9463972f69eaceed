"""Points of the `events` table on a helix: time of day is the angle (midnight is the cut),
the day the place along the axis, and the value the radius."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Control points of the axis: z, x, y.
AXIS = [(0.0, 5.0, -3.0), (100.0, 9.0, 1.0), (400.0, -2.0, 6.0)]


def helix_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cid, pid, kind, theta, r, z, wind_a. Every 17th relative label is planted one too high."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    e = e.withColumn("us", us).withColumn("cid", F.expr("event_id div 25"))
    turn = F.floor(F.col("value") / 20)
    planted = F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    return e.select(
        "cid",
        F.col("event_id").alias("pid"),
        F.expr("CASE cid % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'same' ELSE 'absolute' END").alias("kind"),
        (F.lit(2 * math.pi) * (F.col("us") % DAY) / F.lit(DAY)).alias("theta"),
        (F.lit(100) + F.col("value")).alias("r"),
        (F.lit(10.0) * F.expr(f"us div {DAY}")).alias("z"),
        F.expr("cid % 3").alias("_k"),
        turn.alias("_turn"),
        planted.alias("_planted"),
    ).select("cid", "pid", "kind", "theta", "r", "z", F.when(F.col("_k") == 0, F.col("_turn") + F.col("_planted")).when(F.col("_k") == 2, F.col("_turn")).cast("double").alias("wind_a"))


def axis_table(spark: SparkSession, points: list[tuple[float, float, float]] = AXIS) -> DataFrame:
    """z, x, y of the axis' control points."""
    return spark.createDataFrame(points, "z double, x double, y double")


POINTS_SQL = """
ev AS (SELECT event_id, value, epoch_us(ts) - epoch_us(timestamp '2024-01-01') AS us FROM events),
points AS (SELECT event_id // 25 AS cid, event_id AS pid,
  CASE (event_id // 25) % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'same' ELSE 'absolute' END AS kind,
  2 * pi() * (us % 86400000000) / 86400000000 AS theta, 100 + value AS r, 1e1 * (us // 86400000000) AS z,
  CASE (event_id // 25) % 3 WHEN 0 THEN floor(value / 20) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END
    WHEN 2 THEN floor(value / 20) END AS wind_a FROM ev)
"""
