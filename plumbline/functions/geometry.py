"""Scalar expressions over points in a cylindrical frame, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def sense_sign(sense: str) -> int:
    """+1 for CW and -1 for ACW, in any case."""
    signs = {"CW": 1, "ACW": -1}
    if sense.upper() not in signs:
        raise ValueError(f"spiral sense must be CW or ACW, not {sense!r}")
    return signs[sense.upper()]


def wrap_angle(d: Column) -> Column:
    """d moved by whole turns into (-pi, pi]."""
    return d - F.lit(TWO_PI) * F.ceil((d - F.lit(math.pi)) / F.lit(TWO_PI))


def cut_crossing(before: Column, after: Column) -> Column:
    """Signed crossings of the cut at angle 0 on the short way: +1, -1 or 0. Half a turn
    exactly crosses nothing."""
    d = after - before
    return F.when(d < -math.pi, 1).when(d > math.pi, -1).otherwise(0)


def label_diff(label_a: Column, theta_a: Column, label_b: Column, theta_b: Column, sense: int) -> Column:
    """Winding of a minus winding of b, in the branch of a."""
    return label_a - label_b + F.lit(sense) * cut_crossing(theta_a, theta_b)


def node_tag(kind: Column, cid: Column) -> Column:
    return F.concat_ws(":", kind, cid)


def node_key(kind: Column, cid: Column) -> Column:
    """Sorts as (kind, cid) does: whole-number ids by value, cluster ids as text."""
    number = cid.cast("string")
    return F.concat_ws(":", kind, F.when(number.rlike("^[0-9]+$"), F.lpad(number, 19, "0")).otherwise(number))


def theta_cells(dtheta: float) -> int:
    """Cells around the circle, three at least; half rounds to even."""
    return max(3, round(TWO_PI / dtheta))


def sector_cell(theta: Column, z: Column, dz: float, dtheta: float) -> tuple[Column, Column]:
    n = theta_cells(dtheta)
    return F.floor(z / F.lit(dz)), F.pmod(F.floor(theta / F.lit(TWO_PI) * F.lit(n)), F.lit(n))


def projected_gap(a: dict[str, Column], b: dict[str, Column], strict_dz: float) -> Column:
    """Radial gap r_a - r_b at a common z. a, b: r, z, slope. Null where neither slope is
    known and the points are over strict_dz apart."""
    dz = b["z"] - a["z"]
    middle = F.lit(0.5) * (a["z"] + b["z"])
    both = (a["r"] + a["slope"] * (middle - a["z"])) - (b["r"] + b["slope"] * (middle - b["z"]))
    return (
        F.when(a["slope"].isNull() & b["slope"].isNull(), F.when(F.abs(dz) <= F.lit(strict_dz), a["r"] - b["r"]))
        .when(a["slope"].isNull(), a["r"] - (b["r"] + b["slope"] * (a["z"] - b["z"])))
        .when(b["slope"].isNull(), (a["r"] + a["slope"] * dz) - b["r"])
        .otherwise(both)
    )


def cylindrical(x: Column, y: Column, axis_x: Column, axis_y: Column) -> tuple[Column, Column]:
    """(r, theta) around the axis, theta in [0, 2 pi)."""
    theta = F.pmod(F.atan2(y - axis_y, x - axis_x), F.lit(TWO_PI))
    return F.hypot(x - axis_x, y - axis_y), F.when(theta >= F.lit(TWO_PI), F.lit(0.0)).otherwise(theta)


def frame_twist(theta: Column, r: Column, z: Column, a: float, b: float, c: float) -> Column:
    """A smooth change of frame: a sin(z / 700 + 0.3) + b cos(r / 150) + c sin(theta)."""
    return F.lit(a) * F.sin(z / 700 + F.lit(0.3)) + F.lit(b) * F.cos(r / 150) + F.lit(c) * F.sin(theta)


def gap_width(a: Column, b: Column) -> Column:
    """Angular width of the gap between two angles, without sign."""
    return F.abs(wrap_angle(a - b))
