"""Gridded surface patches in long form: cells (patch_id, i, j, x, y, z), valid ones only.

Neighbourhoods are made by sending each cell to the quads (or crosses) it belongs to and
grouping once, not by joining a patch with itself. Only the search of routes within one patch,
whose grid bounds it, is Python, a patch a group.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import cut_crossing
from plumbline.operators.components import connected_components, durable
from plumbline.operators.frame import to_cylindrical

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
MEDIAL = 4.0
TOLERANCE = 2.5
STRIP = 64
STRETCH = 64
STEPS = [(a, b, math.hypot(a, b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def valid_cells(grid: DataFrame) -> DataFrame:
    """Cells that aren't exactly (-1, -1, -1)."""
    return grid.where("not (x = -1 and y = -1 and z = -1)")


def quads(cells: DataFrame) -> DataFrame:
    """patch_id, i, j and corners c00, c01, c10, c11 of the quads whose four corners are valid."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CORNERS]))
    p = cells.select("patch_id", "i", "j", F.struct("x", "y", "z").alias("c")).withColumn("_q", at)
    g = p.groupBy("patch_id", (F.col("i") - F.col("_q.a")).alias("i"), (F.col("j") - F.col("_q.b")).alias("j"))
    corner = [F.max(F.when((F.col("_q.a") == a) & (F.col("_q.b") == b), F.col("c"))).alias(f"c{a}{b}") for a, b in CORNERS]
    return g.agg(F.count(F.lit(1)).alias("n"), *corner).where("n = 4").drop("n")


def erode(cells: DataFrame, rounds: int = 1) -> DataFrame:
    """Cells that keep all four neighbours through `rounds` rounds; beyond the grid is nothing."""
    now = cells
    cross = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    for _ in range(rounds):
        p = now.select("patch_id", "i", "j", F.struct("x", "y", "z").alias("c")).withColumn("_s", cross)
        g = p.groupBy("patch_id", (F.col("i") + F.col("_s.a")).alias("i"), (F.col("j") + F.col("_s.b")).alias("j"))
        own = F.max(F.when((F.col("_s.a") == 0) & (F.col("_s.b") == 0), F.col("c"))).alias("c")
        now = g.agg(F.count(F.lit(1)).alias("n"), own).where("n = 5 and c is not null").select("patch_id", "i", "j", "c.x", "c.y", "c.z")
    return now


def patch_areas(cells: DataFrame, scale_i: float = 1.0, scale_j: float = 1.0) -> DataFrame:
    """patch_id, n_quads, area, z_min, z_max of the quads' corners."""
    q = quads(cells)
    low, high = F.least(*[f"c{a}{b}.z" for a, b in CORNERS]), F.greatest(*[f"c{a}{b}.z" for a, b in CORNERS])
    return q.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_quads"), (F.count(F.lit(1)) / F.lit(scale_i * scale_j)).alias("area"), F.min(low).alias("z_min"), F.max(high).alias("z_max"))


def in_band(areas: DataFrame, low: float, high: float) -> DataFrame:
    """Patches whose extent meets the half-open band [low, high)."""
    return areas.where((F.col("z_min") < high) & (F.col("z_max") >= low))


def lift(places: DataFrame, quad_table: DataFrame) -> DataFrame:
    """places (patch_id, fi, fj, ...) with x, y, z by bilinear interpolation and valid; -1 and
    false off valid quads."""
    p = places.withColumn("i", F.floor("fi")).withColumn("j", F.floor("fj"))
    q = p.join(quad_table, ["patch_id", "i", "j"], "left")
    u, v = F.col("fi") - F.col("i"), F.col("fj") - F.col("j")

    def mix(axis: str) -> Column:
        top = F.col(f"c00.{axis}") * (1 - v) + F.col(f"c01.{axis}") * v
        low = F.col(f"c10.{axis}") * (1 - v) + F.col(f"c11.{axis}") * v
        return F.coalesce(top * (1 - u) + low * u, F.lit(-1.0))

    return q.select(*places.columns, mix("x").alias("x"), mix("y").alias("y"), mix("z").alias("z"), F.col("c00").isNotNull().alias("valid"))


def densify(lines: DataFrame, step: float = 1.0) -> DataFrame:
    """line_id, k, fi, fj along polylines (line_id, seq, fi, fj) at steps of at most `step`; each
    junction once."""
    w = Window.partitionBy("line_id").orderBy("seq")
    s = lines.withColumn("_ni", F.lead("fi").over(w)).withColumn("_nj", F.lead("fj").over(w)).withColumn("_last", F.lead("seq").over(w).isNull())
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("_ni") - F.col("fi"), F.col("_nj") - F.col("fj")) / F.lit(step)))
    s = s.withColumn("_n", F.when(F.col("_last"), F.lit(1)).otherwise(n).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = F.col("_t") / F.col("_n")
    at = lambda c, d: F.when(F.col("_last"), F.col(c)).otherwise(F.col(c) + (F.col(d) - F.col(c)) * part)
    out = s.select("line_id", at("fi", "_ni").alias("fi"), at("fj", "_nj").alias("fj"), "seq", "_t")
    return out.withColumn("k", F.row_number().over(Window.partitionBy("line_id").orderBy("seq", "_t")) - 1).drop("seq", "_t")


def path_transport(samples: DataFrame, axis: DataFrame) -> DataFrame:
    """line_id, delta, n_valid, n_dropped: signed cut crossings along samples (line_id, k, x, y, z,
    valid); null where fewer than two are valid."""
    counts = samples.groupBy("line_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_dropped"))
    t = to_cylindrical(samples.where("valid"), axis)
    w = Window.partitionBy("line_id").orderBy("k")
    t = t.withColumn("_b", F.lag("theta").over(w))
    d = t.groupBy("line_id").agg(F.sum(F.when(F.col("_b").isNotNull(), cut_crossing(F.col("_b"), F.col("theta"))).otherwise(0)).alias("delta"))
    return counts.join(d, "line_id", "left").withColumn("delta", F.when(F.col("n_valid") >= 2, F.col("delta")))


def triangles(quad_table: DataFrame) -> DataFrame:
    """Two triangles a quad: patch_id, i, j, side and corners a, b, c."""
    tri = lambda s, *c: F.struct(F.lit(s).alias("side"), *[F.col(k).alias(n) for k, n in zip(c, "abc", strict=True)])
    both = F.array(tri(0, "c10", "c00", "c01"), tri(1, "c10", "c01", "c11"))
    return quad_table.select("patch_id", "i", "j", F.inline(both))


def _dot(p: list[Column], q: list[Column]) -> Column:
    return sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])


def _along(product: str, square: str) -> Column:
    """How far along a side the nearest place is, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(product) / F.greatest(F.col(square), F.lit(1e-300))))


def with_triangle_distance(rows: DataFrame) -> DataFrame:
    """rows (p, a, b, c: structs x, y, z) with distance, of p to the triangle: to its plane where
    the foot lies inside, else to the nearest side. Vectors and their products become columns
    first, each computed once."""
    made, kept = rows, [c for c in rows.columns if c not in "pabc"]
    vectors = {"u": ("a", "b"), "v": ("a", "c"), "w": ("a", "p"), "e": ("b", "c"), "f": ("b", "p")}
    flat = [(F.col(f"{q}.{k}") - F.col(f"{p}.{k}")).alias(f"_{n}{k}") for n, (p, q) in vectors.items() for k in "xyz"]
    made = made.select(*kept, *flat)
    of = lambda n: [F.col(f"_{n}{k}") for k in "xyz"]
    products = ("uu", "uv", "vv", "wu", "wv", "ee", "fe")
    made = made.select(*kept, *[f"_{n}{k}" for n in "uvwef" for k in "xyz"], *[_dot(of(n), of(m)).alias(f"_{n}{m}") for n, m in products])
    det, s, t = F.expr("_uu * _vv - _uv * _uv"), F.expr("_vv * _wu - _uv * _wv"), F.expr("_uu * _wv - _uv * _wu")
    made = made.withColumns({"_det": det, "_s": s, "_t": t, "_ab": _along("_wu", "_uu"), "_ac": _along("_wv", "_vv"), "_bc": _along("_fe", "_ee")})
    # a degenerate triangle has no inside, and its det isn't divided by
    made = made.withColumns({f"_o{k}": F.expr(f"CASE WHEN _det > 0 THEN _w{k} - _s / _det * _u{k} - _t / _det * _v{k} END") for k in "xyz"})
    made = made.withColumns({f"_{n}{k}": F.expr(f"_{p}{k} - _{n} * _{q}{k}") for n, p, q in (("ab", "w", "u"), ("ac", "w", "v"), ("bc", "f", "e")) for k in "xyz"})
    inside = F.when(F.expr("_det > 0 and _s >= 0 and _t >= 0 and _s + _t <= _det"), _dot(of("o"), of("o")))
    return made.select(*kept, F.sqrt(F.least(*[_dot(of(n), of(n)) for n in ("ab", "bc", "ac")], inside)).alias("distance"))


def project(points: DataFrame, tri: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Nearest triangle of each patch within tolerance of each point (pid, x, y, z): pid,
    patch_id, distance, i, j. A triangle's box, grown by the tolerance, lies in cells at least as
    wide as itself and less than twice as wide (a power of two, its level), so in eight at
    most; a point probes one cell of each level that occurs. A few large triangles don't
    widen the cells of the others."""
    box = {k: (F.least(f"a.{k}", f"b.{k}", f"c.{k}") - tolerance, F.greatest(f"a.{k}", f"b.{k}", f"c.{k}") + tolerance) for k in "xyz"}
    t = tri
    for k, (lo, hi) in box.items():
        t = t.withColumn(f"_{k}0", lo).withColumn(f"_{k}1", hi)
    wide = F.greatest(F.lit(1e-300), *[F.col(f"_{k}1") - F.col(f"_{k}0") for k in "xyz"])
    t = t.withColumn("_level", F.ceil(F.log2(wide)).cast("int"))
    levels = [r[0] for r in t.select("_level").distinct().collect()]  # a number for each power of two
    if not levels:
        return points.sparkSession.createDataFrame([], "pid long, patch_id string, distance double, i long, j long")
    width = F.pow(F.lit(2.0), F.col("_level"))
    for k in "xyz":
        t = t.withColumn(f"_{k}", F.explode(F.sequence(F.floor(F.col(f"_{k}0") / width), F.floor(F.col(f"_{k}1") / width))))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(level) for level in sorted(levels)])))
    p = p.select("pid", F.struct("x", "y", "z").alias("p"), "_level", *[F.floor(F.col(k) / width).alias(f"_{k}") for k in "xyz"])
    near = t.join(p, ["_level", "_x", "_y", "_z"])
    for k in "xyz":
        near = near.where(F.col(f"p.{k}").between(F.col(f"_{k}0"), F.col(f"_{k}1")))
    near = with_triangle_distance(near.select("pid", "patch_id", "i", "j", "side", "p", "a", "b", "c"))
    best = near.groupBy("pid", "patch_id").agg(F.min(F.struct("distance", "i", "j", "side")).alias("m"))
    # the tolerance after the groups: a filter before them would compute the distance twice
    return best.where(F.col("m.distance") <= tolerance).select("pid", "patch_id", "m.distance", "m.i", "m.j")


def best_patch(hits: DataFrame, areas: DataFrame) -> DataFrame:
    """The hit of each point that counts: on the largest patch, then the nearest, then by id."""
    h = hits.join(areas.select("patch_id", "area"), "patch_id")
    return h.groupBy("pid").agg(F.min(F.struct((-F.col("area")).alias("o"), "distance", "patch_id")).alias("m")).select("pid", "m.patch_id", "m.distance")


def quad_edges(quad_table: DataFrame) -> DataFrame:
    """Neighbouring quads, eight directions: patch_id, i, j, ni, nj, length."""
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(length).alias("l")) for a, b, length in STEPS]))
    q = quad_table.select("patch_id", "i", "j")
    e = q.withColumn("_s", s).select("patch_id", "i", "j", (F.col("i") + F.col("_s.a")).alias("ni"), (F.col("j") + F.col("_s.b")).alias("nj"), F.col("_s.l").alias("length"))
    return e.join(q.select("patch_id", F.col("i").alias("ni"), F.col("j").alias("nj")), ["patch_id", "ni", "nj"], "left_semi")


def edge_distance(quad_table: DataFrame) -> DataFrame:
    """patch_id, i, j, distance: how far each quad is from the nearest place without one, beyond
    the grid too, exactly. Along a row that is where its run of quads ends, by a window; down
    columns, STRIP of them at a time, the least of (rows between)^2 + (that distance)^2."""
    row = Window.partitionBy("patch_id", "i").orderBy("j")
    r = quad_table.select("patch_id", "i", "j").withColumn("_run", F.col("j") - F.row_number().over(row))
    run = Window.partitionBy("patch_id", "i", "_run")
    side = F.least(F.col("j") - F.min("j").over(run), F.max("j").over(run) - F.col("j")) + 1
    r = r.select("patch_id", "i", "j", side.cast("long").alias("side"), F.floor(F.col("j") / STRIP).alias("strip"))

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = frame.i.min() - 1, frame.j.min()
        i, j = (frame.i - top).to_numpy(), (frame.j - left).to_numpy()
        own = np.zeros((i.max() + 2, j.max() + 1), np.int64)
        own[i, j] = frame.side.to_numpy() ** 2
        best, d = own.copy(), 1
        while d * d < best.max():
            np.minimum(best[d:], own[:-d] + d * d, out=best[d:])
            np.minimum(best[:-d], own[d:] + d * d, out=best[:-d])
            d += 1
        return frame[["patch_id", "i", "j"]].assign(distance=np.sqrt(best[i, j]))

    return r.groupBy("patch_id", "strip").applyInPandas(down, "patch_id string, i long, j long, distance double")


class Grid:
    """The quads of one patch as a graph; a step costs more near the edge."""

    def __init__(self, frame: pd.DataFrame):
        self.places = frame[["i", "j"]].to_numpy(np.int64)
        self.low, self.high = self.places.min(axis=0).tolist(), self.places.max(axis=0).tolist()
        cost = 1 + MEDIAL / np.maximum(frame.distance.to_numpy(), 1)
        self.cost = dict(zip(map(tuple, self.places.tolist()), cost.tolist(), strict=True))

    def nearest(self, fi: float, fj: float) -> tuple[int, int]:
        """The quad that holds a place, else the nearest one (first in order)."""
        q = tuple(min(max(math.floor(f), lo), hi) for f, lo, hi in zip((fi, fj), self.low, self.high, strict=True))
        if q in self.cost:
            return q
        apart = ((self.places - q) ** 2).sum(axis=1)
        return tuple(min(self.places[apart == apart.min()].tolist()))

    def before(self, start: tuple[int, int]) -> dict[tuple[int, int], tuple[int, int] | None]:
        """The quad before each that can be reached, on the cheapest way from start."""
        best, came, heap, done = {start: 0.0}, {start: None}, [(0.0, start)], set()
        while heap:
            far, q = heapq.heappop(heap)
            if q in done:
                continue
            done.add(q)
            for a, b, length in STEPS:
                n = (q[0] + a, q[1] + b)
                if n in self.cost and n not in done and far + length * self.cost[n] < best.get(n, math.inf):
                    best[n], came[n] = far + length * self.cost[n], q
                    heapq.heappush(heap, (best[n], n))
        return came


def routes(requests: DataFrame, quad_table: DataFrame) -> DataFrame:
    """request, seq, fi, fj, n_quads: the centres along the cheapest way between two places of a
    patch (request, patch_id, from_i, from_j, to_i, to_j), with the places at its ends; none
    where there is no way. Requests from one place share its tree of ways."""

    def solve(wanted: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        grid = Grid(frame) if len(frame) else None
        for (fi, fj), same in wanted.groupby(["from_i", "from_j"]) if grid else ():
            came = grid.before(grid.nearest(fi, fj))
            for r in same.itertuples():
                at, way = grid.nearest(r.to_i, r.to_j), []
                while at is not None and (way or at in came):
                    way.append((at[0] + 0.5, at[1] + 0.5))
                    at = came[at]
                whole = [(fi, fj), *way[::-1], (r.to_i, r.to_j)] if way else []
                rows += [(r.request, k, x, y, len(way)) for k, (x, y) in enumerate(whole)]
        return pd.DataFrame(rows, columns=["request", "seq", "fi", "fj", "n_quads"])

    kind = requests.schema["request"].dataType.simpleString()
    margins = edge_distance(quad_table).select(F.col("patch_id").alias("patch"), "i", "j", "distance")
    return requests.groupBy("patch_id").cogroup(margins.groupBy("patch")).applyInPandas(solve, f"request {kind}, seq long, fi double, fj double, n_quads long")


def strip_samples(requests: DataFrame, quad_table: DataFrame, step: float = 1.0, lines: DataFrame | None = None) -> DataFrame:
    """line_id (the request), k, x, y, z, valid along the cheapest way between two places, at most
    `step` apart."""
    lines = routes(requests, quad_table) if lines is None else lines
    samples = densify(lines.select(F.col("request").alias("line_id"), "seq", "fi", "fj"), step)
    named = samples.join(requests.select(F.col("request").alias("line_id"), "patch_id"), "line_id")
    return lift(named, quad_table).select("line_id", "k", "x", "y", "z", "valid")


def way_steps(requests: DataFrame, quad_table: DataFrame) -> DataFrame:
    """The steps of the cheapest ways from each place, once however many ways lead along them:
    patch_id, from_i, from_j, number, up (the number of the step before; -1: none), fi, fj, ti, tj
    (its ends: places or quads' centres), n_quads up to its end, request (one that leads along
    it), and asked: whether it is the step from the last centre to the request's place. Steps
    come after the one before them."""

    def solve(wanted: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        grid = Grid(frame) if len(frame) else None
        for (fi, fj), same in wanted.groupby(["from_i", "from_j"]) if grid else ():
            came = grid.before(grid.nearest(fi, fj))
            into: dict[tuple[int, int], tuple[int, int]] = {}  # number of the step into a quad, quads up to it
            start, n = (same.patch_id.iloc[0], fi, fj), 0
            for r in same.itertuples():
                last = at = grid.nearest(r.to_i, r.to_j)
                if at not in came:
                    continue
                new = []
                while at is not None and at not in into:
                    new.append(at)
                    at = came[at]
                for q in reversed(new):
                    up = came[q]
                    before, size = (-1, 0) if up is None else into[up]
                    here = (fi, fj) if up is None else (up[0] + 0.5, up[1] + 0.5)
                    rows.append((*start, n, before, *here, q[0] + 0.5, q[1] + 0.5, size + 1, r.request, False))
                    into[q], n = (n, size + 1), n + 1
                rows.append((*start, n, into[last][0], last[0] + 0.5, last[1] + 0.5, r.to_i, r.to_j, into[last][1], r.request, True))
                n += 1
        return pd.DataFrame(rows, columns=["patch_id", "from_i", "from_j", "number", "up", "fi", "fj", "ti", "tj", "n_quads", "request", "asked"])

    kind = requests.schema["request"].dataType.simpleString()
    margins = edge_distance(quad_table).select(F.col("patch_id").alias("patch"), "i", "j", "distance")
    schema = f"patch_id string, from_i double, from_j double, number long, up long, fi double, fj double, ti double, tj double, n_quads long, request {kind}, asked boolean"
    return requests.groupBy("patch_id").cogroup(margins.groupBy("patch")).applyInPandas(solve, schema)


def strip_deltas(requests: DataFrame, quad_table: DataFrame, axis: DataFrame, step: float = 1.0) -> DataFrame:
    """request, delta, n_quads, n_valid, n_dropped: crossings of the cut along the cheapest way
    between two places, sampled at most `step` apart from place to place; samples off the patch
    are dropped and counted. Null where there is no way, or not two samples on the patch.

    Centres of quads are on the patch, so a way's crossings are the sum of its steps'. Ways from
    one place are a tree: each of its steps is sampled once and sums run along it, so rows are
    as many as quads and requests, whatever the ways' lengths."""
    kind = requests.schema["request"].dataType.simpleString()
    steps = durable(way_steps(requests, quad_table).withColumn("line_id", F.monotonically_increasing_id()), "way-steps")
    n = F.ceil(F.hypot(F.col("ti") - F.col("fi"), F.col("tj") - F.col("fj")) / F.lit(step)).cast("int")
    # a step of no length stands on a centre twice
    long = steps.select("line_id", "patch_id", "fi", "fj", "ti", "tj", n.alias("n")).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c, d: F.when(F.col("k") == F.col("n"), F.col(d)).otherwise(F.col(c) + (F.col(d) - F.col(c)) * (F.col("k") / F.col("n"))).alias(c)
    samples = lift(long.select("line_id", "patch_id", "k", at("fi", "ti"), at("fj", "tj")), quad_table)
    moved = path_transport(samples.select("line_id", "k", "x", "y", "z", "valid"), axis)
    own = steps.join(moved, "line_id", "left").select(
        "patch_id", "from_i", "from_j", "number", "up", "n_quads", "request", "asked", F.coalesce("delta", F.lit(0)).cast("long").alias("delta"),
        # the end of a step is the next one's start
        (F.coalesce("n_valid", F.lit(2)) - (~F.col("asked")).cast("int")).alias("n_valid"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
    )

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, same in frame.groupby(["from_i", "from_j"]):
            same = same.sort_values("number")
            sums = np.zeros((len(same), 3), np.int64)
            asked = same.asked.to_numpy()
            parts = zip(same.up.tolist(), same[["delta", "n_valid", "n_dropped"]].to_numpy(np.int64), strict=True)
            for k, (up, more) in enumerate(parts):
                sums[k] = more if up < 0 else sums[up] + more
            for request, size, found in zip(same.request[asked].tolist(), same.n_quads[asked].tolist(), sums[asked].tolist(), strict=True):
                rows.append((request, found[0] if found[1] >= 2 else None, size, *found[1:]))
        return pd.DataFrame(rows, columns=["request", "delta", "n_quads", "n_valid", "n_dropped"], dtype=object)

    found = own.groupBy("patch_id").applyInPandas(along, f"request {kind}, delta long, n_quads long, n_valid long, n_dropped long")
    return requests.select("request").join(found, "request", "left")


def _blocks(cells: DataFrame, label: Column) -> DataFrame:
    """patch_id, i, j and a, b, c, d: what label says of the four cells of each 2 x 2 block."""
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in CORNERS]))
    own = cells.select("patch_id", "i", "j", label.alias("own")).withColumn("_o", at)
    g = own.groupBy("patch_id", (F.col("i") - F.col("_o.p")).alias("i"), (F.col("j") - F.col("_o.q")).alias("j"))
    return g.agg(*[F.max(F.when((F.col("_o.p") == p) & (F.col("_o.q") == q), F.col("own"))).alias(n) for n, (p, q) in zip("abcd", CORNERS, strict=True)])


def runs(places: DataFrame) -> DataFrame:
    """patch_id, i, lo, hi: places (patch_id, i, j) as runs along rows."""
    numbered = places.withColumn("_r", F.col("j") - F.row_number().over(Window.partitionBy("patch_id", "i").orderBy("j")))
    return numbered.groupBy("patch_id", "i", "_r").agg(F.min("j").alias("lo"), F.max("j").alias("hi")).drop("_r")


def run_components(found: DataFrame, reach: int) -> DataFrame:
    """runs with label: runs of neighbouring rows are joined where they overlap, with reach 1 also
    where they touch at corners."""
    name = F.concat_ws("/", "patch_id", F.col("i").cast("string"), F.col("lo").cast("string"))
    named = durable(found.withColumn("node", name), "runs")
    # runs meet through stretches of columns, so a row's runs aren't all compared with the next row's
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / STRETCH), F.floor(hi / STRETCH)))
    upper = named.select("patch_id", (F.col("i") + 1).alias("i"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("node").alias("a"), spread(F.col("lo") - reach, F.col("hi") + reach).alias("s"))
    lower = named.withColumn("s", spread(F.col("lo"), F.col("hi")))
    meet = upper.join(lower.hint("merge"), ["patch_id", "i", "s"]).where((F.col("l") <= F.col("hi") + reach) & (F.col("h") >= F.col("lo") - reach)).select("a", F.col("node").alias("b")).distinct()
    comp = connected_components(named.select("node", F.col("node").alias("label")), meet)
    return named.join(comp.hint("merge"), "node").drop("node")


def holes(places: DataFrame) -> DataFrame:
    """patch_id, i, j, hole: the cells that places (patch_id, i, j) enclose, cells that share a
    side being in one hole."""
    box = places.groupBy("patch_id").agg(*[f(c).alias(f"{c}{n}") for c in "ij" for f, n in ((F.min, 0), (F.max, 1))])
    own = runs(places)
    row = Window.partitionBy("patch_id", "i").orderBy("lo")
    gaps = own.withColumn("_next", F.lead("lo").over(row)).join(box, "patch_id")
    # between runs, before the first and after the last, up to one cell beyond the box; empty rows whole
    first = F.lag("hi").over(row).isNull()
    side = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    gaps = gaps.withColumn("_first", first).select(
        "patch_id", "i", F.inline(F.array(
            side(F.col("hi") + 1, F.coalesce(F.col("_next") - 1, F.col("j1") + 1)),
            F.when(F.col("_first"), side(F.col("j0") - 1, F.col("lo") - 1)).otherwise(side(F.lit(1), F.lit(0))),
        )),
    ).where("lo <= hi")
    rows = box.select("patch_id", F.explode(F.sequence(F.col("i0") - 1, F.col("i1") + 1)).alias("i"), (F.col("j0") - 1).alias("lo"), (F.col("j1") + 1).alias("hi"))
    empty = rows.join(own, ["patch_id", "i"], "left_anti").select("patch_id", "i", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    whole = durable(run_components(gaps.unionAll(empty), 0), "gaps")
    outside = whole.join(box, "patch_id").where("i = i0 - 1").select("patch_id", "label").distinct()
    inner = whole.join(outside, ["patch_id", "label"], "left_anti")
    return inner.select("patch_id", "i", F.explode(F.sequence("lo", "hi")).alias("j"), F.col("label").alias("hole"))


def integrability(quad_table: DataFrame, axis: DataFrame) -> DataFrame:
    """patch_id, n_quads, n_components, n_edges, n_blocks, n_holes, n_inconsistent, max_residual,
    invalid_midpoints: whether the cut's crossings between neighbouring quads (eight directions,
    diagonals through the corner that they share, if that can be measured) add up to none on
    every closed way of a patch.

    Ways are sums of elementary ones: triangles within blocks of 2 x 2 quads (three at least), and
    one way around each hole. n_inconsistent counts the blocks and holes with one that doesn't
    add up to 0, max_residual is the greatest sum. Each is measured where it is; no way is
    followed through a patch."""
    mean = lambda k: sum((F.col(f"c{a}{b}.{k}") for a, b in CORNERS[1:]), F.col("c00." + k)) / 4
    q = durable(quad_table.select("patch_id", "i", "j", *[mean(k).alias(k) for k in "xyz"], *[F.col(f"c00.{k}").alias(f"k{k}") for k in "xyz"]), "centres")
    angle = to_cylindrical(q.select("patch_id", "i", "j", "x", "y", "z"), axis).select("patch_id", "i", "j", F.col("theta").alias("t"))
    corner = to_cylindrical(q.select("patch_id", "i", "j", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z")), axis).select("patch_id", "i", "j", F.col("theta").alias("k"))
    cells = durable(angle.join(corner.hint("merge"), ["patch_id", "i", "j"]), "angles")
    block = durable(_blocks(cells, F.struct("t", "k")), "blocks")
    t = lambda n: F.col(f"{n}.t")
    has = {n: F.col(n).isNotNull() for n in "abcd"}
    mid = F.col("d.k")
    straight = lambda p, r: F.when(has[p] & has[r], cut_crossing(t(p), t(r)))
    bent = lambda p, r: F.when(has[p] & has[r], cut_crossing(t(p), mid) + cut_crossing(mid, t(r)))
    across = lambda p, r: F.when(mid.isNotNull(), bent(p, r)).otherwise(straight(p, r))
    known = block.select("patch_id", "i", "j", *[straight(p, r).alias(p + r) for p, r in ("ab", "ac", "bd", "cd")], across("a", "d").alias("ad"), across("b", "c").alias("bc"), *[v.alias("has_" + n) for n, v in has.items()])
    known = durable(known, "steps")
    faces = F.array(F.expr("ab + bd - ad"), F.expr("ac + cd - ad"), F.expr("ab + bc - ac"), F.expr("bc + cd - bd"))
    worst = F.array_max(F.transform(F.filter(faces, lambda x: x.isNotNull()), lambda x: F.abs(x)))
    per_face = known.select("patch_id", worst.alias("sum")).where("sum is not null")
    # a block has its own diagonals, its upper side and its left one; those below and right are others' own
    sides = F.array(*[F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(0) for c in ("ab", "ac", "ad", "bc")])
    of_blocks = known.groupBy("patch_id").agg(F.sum(F.aggregate(sides, F.lit(0), lambda x, y: x + y)).alias("n_edges"), F.count_if(F.col("bc").isNotNull() & ~F.col("has_d")).alias("invalid_midpoints"))
    # around a hole, the block's cells in it on the left hand
    inside = holes(cells.select("patch_id", "i", "j"))
    corners = _blocks(inside, F.col("hole")).select("patch_id", "i", "j", *[F.col(n).alias("h" + n) for n in "abcd"])
    near = corners.join(known.hint("merge"), ["patch_id", "i", "j"], "left")
    ring, turn = "abdc", {("a", "b"): F.col("ab"), ("b", "d"): F.col("bd"), ("d", "c"): -F.col("cd"), ("c", "a"): -F.col("ac"), ("a", "d"): F.col("ad"), ("b", "c"): F.col("bc")}
    turn |= {(r, p): -v for (p, r), v in list(turn.items())}
    ways = []
    for n in range(4):
        p, r, s, u = (ring[(n + k) % 4] for k in range(4))
        hp, hr, hs, hu = (F.col("h" + x) for x in (p, r, s, u))
        none = lambda *c: reduce(lambda x, y: x & y, [x.isNull() for x in c])
        ways.append(F.when(hp.isNotNull() & none(hr, hu), F.struct(hp.alias("hole"), turn[u, r].alias("step"))))  # one cell in the hole: from side to side past it
        ways.append(F.when(hp.isNotNull() & hr.isNotNull() & none(hs, hu), F.struct(hp.alias("hole"), turn[u, s].alias("step"))))  # two that share a side
    steps = near.select("patch_id", F.inline(F.filter(F.array(*ways), lambda x: x.isNotNull())))
    per_hole = steps.groupBy("patch_id", "hole").agg(F.sum("step").alias("sum"))
    sums = per_face.withColumn("hole", F.lit(False)).unionAll(per_hole.select("patch_id", "sum", F.lit(True)))
    of_sums = sums.groupBy("patch_id").agg(
        F.count_if(~F.col("hole")).alias("n_blocks"), F.count_if("hole").alias("n_holes"), F.count_if(F.col("sum") != 0).alias("n_inconsistent"), F.max(F.abs("sum")).alias("max_residual"),
    )
    parts = run_components(runs(cells.select("patch_id", "i", "j")), 1).groupBy("patch_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_quads"), F.count_distinct("label").alias("n_components"))
    found = parts.join(of_blocks, "patch_id", "left").join(of_sums, "patch_id", "left")
    counts = ("n_edges", "n_blocks", "n_holes", "n_inconsistent", "max_residual", "invalid_midpoints")
    return found.select("patch_id", "n_quads", "n_components", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
