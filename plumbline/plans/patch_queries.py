"""Registered queries over surface patches and their graph. Patches are grids of 20 x 30
successive events; their heights come from the events' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import linking, measured, patch_graph, patches
from plumbline.operators.components import durable, scratch
from plumbline.operators.frame import to_cylindrical
from plumbline.plans.audit_queries import CFG, _cut, points
from plumbline.sources.collections import flatten, to_documents
from plumbline.sources.helix import POINTS_SQL, axis_table
from plumbline.sources.shards import read_sharded, write_sharded

AXIS = [(-1000.0, 0.0, 0.0), (20000.0, 0.0, 0.0)]
#: z, x, y: beside the patches, at half their extent in y; and through them.
SIDE_AXIS = [(-1000.0, 0.0, 15.0), (20000.0, 0.0, 15.0)]
INNER_AXIS = [(-1000.0, 30.03, 15.07), (20000.0, 30.03, 15.07)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    e = e.select(F.expr("event_id div 600").alias("p"), F.expr("event_id % 600 div 30").alias("i"), F.expr("event_id % 30").alias("j"), "value")
    hole = F.expr("(i * 7 + j * 3) % 29 = 0")
    at = lambda c: F.when(hole, -1.0).otherwise(c)
    angle = F.lit(0.05) * F.col("i")
    g = e.select(
        F.concat(F.lit("p"), F.col("p").cast("string")).alias("patch_id"), "i", "j",
        at((20 + F.col("j")) * F.cos(angle)).alias("x"), at((20 + F.col("j")) * F.sin(angle)).alias("y"), at(F.col("p") * 3 + F.col("i") + F.col("value") / 1000).alias("z"),
    )
    return patches.valid_cells(g)


def patch_areas(spark, sf_dir):
    a = patches.in_band(patches.patch_areas(cells(spark, sf_dir), 2.0, 1.5), 0.0, 1000.0)
    return a.select("patch_id", "n_quads", F.round("area", 6).alias("area"), F.round("z_min", 6).alias("z_min"), F.round("z_max", 6).alias("z_max"))


def patch_erosion(spark, sf_dir):
    return patches.erode(cells(spark, sf_dir), 1).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_cells"))


def patch_lift(spark, sf_dir):
    c = cells(spark, sf_dir)
    places = c.select("patch_id", (F.col("i") + 0.25).alias("fi"), (F.col("j") + 0.75).alias("fj"))
    out = patches.lift(places, patches.quads(c))
    return out.select("patch_id", "fi", "fj", *[F.round(k, 9).alias(k) for k in "xyz"], "valid")


def patch_triangles(spark, sf_dir):
    t = patches.triangles(patches.quads(cells(spark, sf_dir)))
    return t.select("patch_id", "i", "j", "side", F.round((F.col("a.x") + F.col("b.x") + F.col("c.x")) / 3, 6).alias("cx"), F.round((F.col("a.z") + F.col("b.z") + F.col("c.z")) / 3, 6).alias("cz"))


def quad_edges(spark, sf_dir):
    e = patches.quad_edges(patches.quads(cells(spark, sf_dir)))
    return e.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("length"), 6).alias("length"))


def densified(spark, sf_dir):
    lines = points(spark, sf_dir).select(F.col("cid").alias("line_id"), F.col("pid").alias("seq"), (F.col("pid") % 7).cast("double").alias("fi"), (F.col("pid") % 5).cast("double").alias("fj"))
    return patches.densify(lines).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("fi"), 6).alias("sum_i"))


def path_transport(spark, sf_dir):
    c = cells(spark, sf_dir)
    s = c.select(F.concat_ws("/", "patch_id", "j").alias("line_id"), F.col("i").alias("k"), "x", "y", "z", F.lit(True).alias("valid"))
    return patches.path_transport(s, axis_table(spark, AXIS))


def edge_distance(spark, sf_dir):
    return patches.edge_distance(patches.quads(cells(spark, sf_dir))).withColumn("distance", F.round("distance", 9))


def integrability(spark, sf_dir):
    """Around an axis that passes through the patches, one elementary way of each fails."""
    found = patches.integrability(patches.quads(cells(spark, sf_dir)), axis_table(spark, INNER_AXIS))
    return found.drop("n_blocks")


def strip_deltas(spark, sf_dir):
    """From one place of each patch to each of its quads, about an axis whose cut they cross."""
    q = durable(patches.quads(cells(spark, sf_dir)), "quads")
    request = F.substring("patch_id", 2, 20).cast("long") * 600 + F.col("i") * 30 + F.col("j")
    r = q.select(request.alias("request"), "patch_id", F.lit(4.5).alias("from_i"), F.lit(12.5).alias("from_j"), (F.col("i") + 0.5).alias("to_i"), (F.col("j") + 0.5).alias("to_j"))
    return patches.strip_deltas(r, q, axis_table(spark, SIDE_AXIS)).select("request", "delta")


def _hits(spark, sf_dir):
    c = cells(spark, sf_dir)
    q = durable(patches.quads(c), "quads")
    near = c.select((F.substring("patch_id", 2, 20).cast("long") * 600 + F.col("i") * 30 + F.col("j")).alias("pid"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.2).alias("y"), (F.col("z") + 0.4).alias("z"))
    return patches.project(near, patches.triangles(q))


def projection(spark, sf_dir):
    return _hits(spark, sf_dir).select("pid", "patch_id", F.round("distance", 6).alias("distance"))


def attachment(spark, sf_dir):
    hits = durable(_hits(spark, sf_dir), "hits")
    a = patches.best_patch(hits, patches.patch_areas(cells(spark, sf_dir)))
    return a.select("pid", "patch_id", F.round("distance", 6).alias("distance"))


def attached(spark, sf_dir):
    """Helix points with a patch by sector of angle and axis; every fifth has none."""
    patch = F.concat_ws("_", F.floor(F.col("z") / 20).cast("string"), F.floor(F.col("theta") * 3 / F.lit(3.141592653589793)).cast("string"))
    return points(spark, sf_dir).withColumn("patch_id", F.when(F.col("pid") % 5 != 0, patch))


def hit_gate(spark, sf_dir):
    p = attached(spark, sf_dir).withColumn("hit", F.col("r") < 600)
    return patch_graph.hit_gate(p).groupBy("cid").agg(F.count_if("gated").alias("n_gated"))


def relative_edges(spark, sf_dir):
    return patch_graph.relative_edges(attached(spark, sf_dir), CFG.sense)


def _reached(spark, sf_dir):
    """Relative edges, and what the least patch of each component reaches."""
    e = durable(relative_edges(spark, sf_dir), "relative")
    roots = patch_graph.component_roots(e, attached(spark, sf_dir).where("patch_id is not null"))
    return e, durable(patch_graph.reach(e, roots), "reached")


def patch_reach(spark, sf_dir):
    return _reached(spark, sf_dir)[1]


def patch_loops(spark, sf_dir):
    e, reached = _reached(spark, sf_dir)
    return patch_graph.loop_holonomies(reached, e).groupBy("holonomy").agg(F.count(F.lit(1)).alias("n_loops"))


def loop_cycles(spark, sf_dir):
    e, reached = _reached(spark, sf_dir)
    return patch_graph.loop_cycles(reached, e)


def anchor_votes(spark, sf_dir):
    _, reached = _reached(spark, sf_dir)
    return patch_graph.anchor_votes(reached, attached(spark, sf_dir).where("kind = 'absolute' and patch_id is not null"))


def disconnected_subgraphs(spark, sf_dir):
    p = attached(spark, sf_dir).where("patch_id is not null")
    areas = p.groupBy("patch_id").agg(F.count(F.lit(1)).cast("double").alias("area"))
    return patch_graph.disconnected_subgraphs(durable(relative_edges(spark, sf_dir), "relative"), areas)


def named_pairs(spark, sf_dir):
    e = relative_edges(spark, sf_dir)
    names = e.select(F.concat(F.lit("between_patches__"), "from_patch", F.lit("__"), "to_patch").alias("name")).distinct()
    return patch_graph.named_pairs(names, attached(spark, sf_dir).where("patch_id is not null"))


def incremental_links(spark, sf_dir):
    p = attached(spark, sf_dir)
    later = p.where("patch_id is null and r < 500").select("pid", F.lit("new").alias("patch_id"))
    return patch_graph.link_new(p, later).groupBy("cid").agg(F.count("patch_id").alias("n_attached"))


def _surface_edges(spark, sf_dir):
    """Forty traces that visit all patches, point by point a little beside the surface, and the
    edges that they make; entries, quads and axis."""
    q = durable(patches.quads(cells(spark, sf_dir)), "quads")
    axis = axis_table(spark, SIDE_AXIS)
    middle = patches.lift(q.select("patch_id", "i", "j", (F.col("i") + 0.5).alias("fi"), (F.col("j") + 0.5).alias("fj")), q)
    pid = F.substring("patch_id", 2, 20).cast("long") * 600 + F.col("i") * 30 + F.col("j")
    p = middle.select("patch_id", "fi", "fj", pid.alias("pid"), (pid % 40).alias("cid"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.2).alias("y"), (F.col("z") + 0.4).alias("z"), (pid % 9).cast("double").alias("wind_a"))
    p = durable(to_cylindrical(p, axis), "traces")
    e = patch_graph.relative_edges(p.select("cid", "pid", "theta", "wind_a", "patch_id"), CFG.sense)
    side = lambda n, s: p.select(F.col("pid").alias(f"pid_{n}"), F.col("fi").alias(f"{n}_i"), F.col("fj").alias(f"{n}_j"), *[F.col(k).alias(f"{s}{k}") for k in "xyz"])
    edges = e.join(side("from", "f"), "pid_from").join(side("to", "t"), "pid_to")
    entries = p.select("patch_id").distinct().withColumn("i", F.lit(4.5)).withColumn("j", F.lit(12.5))
    return edges, entries, q, axis


def measured_edges(spark, sf_dir):
    found = measured.measured_edges(*_surface_edges(spark, sf_dir))
    return found.select("from_patch", "to_patch", "cid", "pid_from", "pid_to", "delta", "gap_from", "gap_to", "measured")


def corrected_reach(spark, sf_dir):
    """Windings of patches by the traces' own deltas, then with the gaps of the edges that reach
    them."""
    found = durable(measured.measured_edges(*_surface_edges(spark, sf_dir)), "measured")
    reached = durable(patch_graph.reach(found, found.select(F.min("from_patch").alias("patch_id"))), "reached")
    base = reached.select(F.col("patch_id").alias("via"), F.col("winding").alias("_w"))
    own = reached.join(base, "via").select("patch_id", "via", (F.col("winding") - F.col("_w")).alias("delta"))
    ways = F.array(*[F.struct(F.col(a).alias("via"), F.col(b).alias("patch_id"), (s * F.col("delta")).alias("delta"), (s * (F.col("gap_from") + F.col("gap_to"))).alias("change"), F.struct("cid", "pid_from", "pid_to").alias("w")) for a, b, s in (("from_patch", "to_patch", 1), ("to_patch", "from_patch", -1))])
    told = found.select(F.inline(ways)).join(own, ["patch_id", "via", "delta"]).groupBy("patch_id").agg(F.min_by("change", "w").alias("change"))
    after = measured.shifted_windings(reached, told)
    return after.join(reached.select("patch_id", F.col("winding").alias("uncorrected")), "patch_id").select("patch_id", "hops", "uncorrected", F.col("winding").alias("corrected"))


def _offers(spark, sf_dir):
    """Helix points as unlinked traces, some of them named after two patches, and hits of each on
    up to three patches: one by height and angle, one by radius, and one by height alone."""
    p = points(spark, sf_dir)
    sector = F.concat_ws("_", F.floor(F.col("z") / 20).cast("string"), F.floor(F.col("theta") * 3 / F.lit(3.141592653589793)).cast("string"))
    ring, slab = (F.concat(F.lit(mark), F.floor(F.col(c) / wide).cast("string")) for mark, c, wide in (("r", "r", 150.0), ("z", "z", 40.0)))
    hit = lambda patch, distance, on: F.when(on, F.struct(patch.alias("patch_id"), distance.alias("distance")))
    part = F.col("r") / 50 - F.floor(F.col("r") / 50)
    offers = F.array(hit(sector, part, F.col("pid") % 5 != 0), hit(ring, 1 - part, F.col("pid") % 3 != 0), hit(slab, F.lit(0.5), part > 0.25))
    hits = p.select("pid", F.inline(F.filter(offers, lambda x: x.isNotNull())))
    first = F.concat(F.lit("r"), F.expr("cid % 7").cast("string"))
    name = F.when(F.col("cid") % 11 == 0, F.concat(F.lit("between_patches__"), first, F.lit("__z1"))).otherwise(F.lit("trace"))
    traces = p.select("cid", "pid", "wind_a", (F.col("kind") == "absolute").alias("absolute"), name.alias("name"), F.lit(None).cast("string").alias("patch_id"))
    areas = hits.groupBy("patch_id").agg(F.count(F.lit(1)).cast("double").alias("area"))
    pairs = patch_graph.named_pairs(traces.select("name").distinct(), areas)
    return traces, hits, areas, pairs


def nearest_links(spark, sf_dir):
    traces, hits, areas, pairs = _offers(spark, sf_dir)
    return linking.chosen_links(traces, hits, areas, pairs, "nearest", 5, 3).withColumn("distance", F.round("distance", 9))


def largest_links(spark, sf_dir):
    traces, hits, areas, pairs = _offers(spark, sf_dir)
    return linking.chosen_links(traces, hits, areas, pairs, "largest_area", 5, 3).withColumn("distance", F.round("distance", 9))


def new_patch_gains(spark, sf_dir):
    """Links to patches by radius first, then what those by height and angle add, per trace."""
    traces, hits, areas, pairs = _offers(spark, sf_dir)
    old = hits.where(F.col("patch_id").startswith("r"))
    linked = durable(linking.linked_points(traces, linking.chosen_links(traces, old, areas, pairs, "nearest", 5, 3)), "linked")
    new = hits.where(~F.col("patch_id").startswith("r"))
    return linking.gains(linked, linking.link_new_patches(linked, new, areas, pairs, "nearest", 5, 3))


def _collections(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(F.col("kind").alias("source"), "cid", "pid", F.col("r").alias("x"), F.col("theta").alias("y"), "z", "wind_a", F.concat(F.lit("c"), F.col("cid").cast("string")).alias("name"), (F.col("kind") == "absolute").alias("is_absolute"))


def collection_round_trip(spark, sf_dir):
    """The helix written as point-collection documents, one a kind, and read again."""
    back = flatten(to_documents(_collections(spark, sf_dir)))
    return back.select("source", "cid", "pid", F.round("x", 6).alias("x"), "z", "wind_a", "name", "is_absolute")


def sharded_round_trip(spark, sf_dir):
    """The helix written to documents of some 500 points and read again."""
    path = scratch(spark, "collections")
    write_sharded(_collections(spark, sf_dir), path, points_per_document=500)
    return read_sharded(spark, path).select("source", "cid", "pid", F.round("x", 6).alias("x"), "z", "wind_a", "name", "is_absolute")


CELLS_SQL = """
gr AS (SELECT event_id // 600 AS p, event_id % 600 // 30 AS i, event_id % 30 AS j, value FROM events),
cells AS (SELECT 'p' || p AS patch_id, i, j, (20 + j) * cos(5e-2 * i) AS x, (20 + j) * sin(5e-2 * i) AS y, p * 3 + i + value / 1e3 AS z FROM gr WHERE (i * 7 + j * 3) % 29 <> 0),
quads AS (SELECT a.patch_id, a.i, a.j, a.x AS x00, a.y AS y00, a.z AS z00, b.x AS x01, b.y AS y01, b.z AS z01, c.x AS x10, c.y AS y10, c.z AS z10, d.x AS x11, d.y AS y11, d.z AS z11
  FROM cells a JOIN cells b ON b.patch_id = a.patch_id AND b.i = a.i AND b.j = a.j + 1 JOIN cells c ON c.patch_id = a.patch_id AND c.i = a.i + 1 AND c.j = a.j JOIN cells d ON d.patch_id = a.patch_id AND d.i = a.i + 1 AND d.j = a.j + 1)"""
ATTACHED_SQL = f"""{POINTS_SQL}, att AS (SELECT *, CASE WHEN pid % 5 <> 0 THEN CAST(floor(z / 2e1) AS BIGINT) || '_' || CAST(floor(theta * 3 / 3.141592653589793e0) AS BIGINT) END AS patch_id FROM points)"""
RELATIVE_SQL = f"""{ATTACHED_SQL},
ct AS (SELECT *, CASE WHEN theta - lag(theta) OVER w < -pi() THEN 1 WHEN theta - lag(theta) OVER w > pi() THEN -1 ELSE 0 END AS cut FROM att WINDOW w AS (PARTITION BY cid ORDER BY pid)),
cu AS (SELECT *, sum(cut) OVER (PARTITION BY cid ORDER BY pid) AS cuts FROM ct),
le AS (SELECT *, lead(patch_id) OVER w AS np, lead(pid) OVER w AS npid, lead(wind_a) OVER w AS nw, lead(cuts) OVER w AS nc FROM cu WHERE patch_id IS NOT NULL WINDOW w AS (PARTITION BY cid ORDER BY pid)),
rel AS (SELECT patch_id AS from_patch, np AS to_patch, cid, pid AS pid_from, npid AS pid_to, CAST(coalesce(nw - wind_a, 0) AS BIGINT) - CAST(nc - cuts AS BIGINT) AS delta FROM le WHERE np <> patch_id)"""

REACH_SQL = f"""{RELATIVE_SQL},
ee AS (SELECT from_patch AS x, to_patch AS y, delta AS o, cid, pid_from AS pf, pid_to AS pt FROM rel UNION ALL SELECT to_patch, from_patch, -delta, cid, pid_to, pid_from FROM rel),
wi AS (SELECT x, y, o, min(row(cid, pf, pt)) AS w FROM ee GROUP BY ALL),
pa AS (SELECT DISTINCT patch_id AS x FROM att WHERE patch_id IS NOT NULL),
rc(x, y) AS (SELECT x, x FROM pa UNION SELECT rc.x, wi.y FROM rc JOIN wi ON rc.y = wi.x),
cm AS (SELECT x, min(y) AS root FROM rc GROUP BY x),
lv(x, d) AS (SELECT DISTINCT root, 0 FROM cm UNION SELECT wi.y, d + 1 FROM lv JOIN wi ON wi.x = lv.x WHERE d < (SELECT count(*) FROM pa)),
ds AS (SELECT x, min(d) AS d FROM lv GROUP BY x),
tr AS (SELECT c.x, min(row(wi.x, wi.o)) AS up FROM ds c JOIN wi ON wi.y = c.x JOIN ds p ON p.x = wi.x AND p.d = c.d - 1 GROUP BY c.x),
an(x, y, k, pot) AS (SELECT x, x, 0, 0::BIGINT FROM ds UNION ALL SELECT an.x, tr.up[1], k + 1, pot + tr.up[2] FROM an JOIN tr ON tr.x = an.y),
rd AS (SELECT cm.x AS patch_id, root, CAST(ds.d AS INT) AS hops, an.pot AS winding, tr.up[1] AS via FROM cm JOIN ds USING (x) JOIN an ON an.x = cm.x AND an.k = ds.d LEFT JOIN tr ON tr.x = cm.x),
lp AS (SELECT wi.x, wi.y, wi.o, b.winding - a.winding - wi.o AS h FROM wi JOIN rd a ON a.patch_id = wi.x JOIN rd b ON b.patch_id = wi.y WHERE wi.x < wi.y
  AND NOT (coalesce(b.via = wi.x, false) OR coalesce(a.via = wi.y, false)) OR wi.x < wi.y AND b.winding - a.winding <> wi.o)"""

OFFERS_SQL = f"""{POINTS_SQL}, pt AS (SELECT *, r / 50 - floor(r / 50) AS part, row_number() OVER (PARTITION BY cid ORDER BY pid) AS i, count(*) OVER (PARTITION BY cid) AS n,
  CASE WHEN cid % 11 = 0 THEN 'r' || (cid % 7) END AS first FROM points),
ht AS (SELECT pid, CAST(floor(z / 2e1) AS BIGINT) || '_' || CAST(floor(theta * 3 / 3.141592653589793e0) AS BIGINT) AS patch_id, part AS distance FROM pt WHERE pid % 5 <> 0
  UNION ALL SELECT pid, 'r' || CAST(floor(r / 1.5e2) AS BIGINT), 1 - part FROM pt WHERE pid % 3 <> 0 UNION ALL SELECT pid, 'z' || CAST(floor(z / 4e1) AS BIGINT), 5e-1 FROM pt WHERE part > 0.25),
ara AS (SELECT patch_id, count(*) AS area FROM ht GROUP BY patch_id),
nm AS (SELECT *, first IS NOT NULL AND first IN (SELECT patch_id FROM ara) AND 'z1' IN (SELECT patch_id FROM ara) AS paired FROM pt),
al AS (SELECT ht.*, cid, i, n, paired, kind, wind_a FROM ht JOIN nm USING (pid) WHERE NOT paired OR patch_id IN (first, 'z1')),
gt AS (SELECT a.*, (SELECT count(*) FROM al b WHERE b.cid = a.cid AND b.patch_id = a.patch_id AND abs(b.i - a.i) <= 2) >= least(3, least(a.i + 2, a.n) - greatest(a.i - 2, 1) + 1) AS fair FROM al a)"""


MEASURED_SQL = f"""{CELLS_SQL},
md AS (SELECT patch_id, CAST(substr(patch_id, 2) AS BIGINT) * 600 + i * 30 + j AS pid, (y00 + y01 + y10 + y11) / 4 >= 15 AS own, (y00 + y01 + y10 + y11) / 4 + 0.2 >= 15 AS up FROM quads),
tl AS (SELECT pid % 40 AS cid, *, CAST(up AS INT) - CAST(lag(up) OVER w AS INT) AS cut, pid % 9 AS wind_a FROM md WINDOW w AS (PARTITION BY pid % 40 ORDER BY pid)),
tc AS (SELECT *, sum(cut) OVER (PARTITION BY cid ORDER BY pid) AS cuts FROM tl),
tn AS (SELECT *, lead(patch_id) OVER w AS np, lead(pid) OVER w AS npid, lead(wind_a) OVER w AS nw, lead(coalesce(cuts, 0)) OVER w AS nc, lead(own) OVER w AS nown, lead(up) OVER w AS nup FROM tc WINDOW w AS (PARTITION BY cid ORDER BY pid)),
ent AS (SELECT patch_id, (y00 + y01 + y10 + y11) / 4 >= 15 AS own FROM quads WHERE i = 4 AND j = 12),
me AS (SELECT tn.patch_id AS from_patch, np AS to_patch, cid, pid AS pid_from, npid AS pid_to, CAST(nw - wind_a - (nc - coalesce(cuts, 0)) AS BIGINT) AS delta, CAST(up AS INT) - CAST(tn.own AS INT) AS gap_from, CAST(nown AS INT) - CAST(nup AS INT) AS gap_to,
  CAST(tn.own AS INT) - CAST(p.own AS INT) AS sf, CAST(nown AS INT) - CAST(r.own AS INT) AS st FROM tn JOIN ent p ON p.patch_id = tn.patch_id JOIN ent r ON r.patch_id = np WHERE np <> tn.patch_id)"""


def _vector(name: str, start: str, end: str) -> str:
    return ", ".join(f"{end}{k} - {start}{k} AS {name}{k}" for k in "xyz")


def _product(p: str, q: str) -> str:
    return " + ".join(f"{p}{k} * {q}{k}" for k in "xyz")


def _square(of: str) -> str:
    """Of the vector whose component k is `of` with K in k's place."""
    return " + ".join(f"({of.replace('K', k)}) * ({of.replace('K', k)})" for k in "xyz")


PROJECTION_SQL = f"""{CELLS_SQL},
tg AS (SELECT patch_id, i, j, 0 AS side, {", ".join(f"{k}10 AS l{k}, {k}00 AS m{k}, {k}01 AS n{k}" for k in "xyz")} FROM quads
  UNION ALL SELECT patch_id, i, j, 1, {", ".join(f"{k}10, {k}01, {k}11" for k in "xyz")} FROM quads),
pp AS (SELECT CAST(substr(patch_id, 2) AS BIGINT) * 600 + i * 30 + j AS pid, x + 0.3 AS px, y + 0.2 AS py, z + 0.4 AS pz FROM cells),
nr AS (SELECT pid, tg.*, px, py, pz FROM tg JOIN pp ON {" AND ".join(f"p{k} >= least(l{k}, m{k}, n{k}) - 2.5 AND p{k} <= greatest(l{k}, m{k}, n{k}) + 2.5" for k in "xyz")}),
vc AS (SELECT pid, patch_id, {_vector("u", "l", "m")}, {_vector("v", "l", "n")}, {_vector("w", "l", "p")}, {_vector("e", "m", "n")}, {_vector("f", "m", "p")} FROM nr),
pr AS (SELECT *, {", ".join(f"{_product(p, q)} AS {p}{q}" for p, q in ("uu", "uv", "vv", "wu", "wv", "ee", "fe"))} FROM vc),
sd AS (SELECT *, uu * vv - uv * uv AS det, vv * wu - uv * wv AS s, uu * wv - uv * wu AS t, greatest(0, least(1, wu / greatest(uu, 1e-300))) AS ab, greatest(0, least(1, wv / greatest(vv, 1e-300))) AS ac,
  greatest(0, least(1, fe / greatest(ee, 1e-300))) AS bc FROM pr),
dd AS (SELECT pid, patch_id, sqrt(least({_square("wK - ab * uK")}, {_square("wK - ac * vK")}, {_square("fK - bc * eK")},
  CASE WHEN det > 0 AND s >= 0 AND t >= 0 AND s + t <= det THEN {_square("wK - s / det * uK - t / det * vK")} END)) AS d FROM sd),
hits AS (SELECT pid, patch_id, min(d) AS distance FROM dd GROUP BY ALL HAVING min(d) <= 2.5)"""


def _theta(name: str, axis: list[tuple[float, float, float]]) -> str:
    _, x, y = axis[0]
    angle = f"atan2({name}y - {y!r}::DOUBLE, {name}x - {x!r}::DOUBLE)"
    return f"CASE WHEN {angle} < 0 THEN {angle} + 2 * pi() ELSE {angle} END"


ROUND_TRIP_SQL = f"WITH {POINTS_SQL} SELECT kind AS source, cid, pid, round(r, 6) AS x, z, wind_a, 'c' || cid AS name, kind = 'absolute' AS is_absolute FROM points"

QUERIES = {
    "patch_areas": (
        patch_areas,
        f"""WITH {CELLS_SQL} SELECT patch_id, count(*) AS n_quads, round(count(*) / 3e0, 6) AS area, round(min(least(z00, z01, z10, z11)), 6) AS z_min, round(max(greatest(z00, z01, z10, z11)), 6) AS z_max
FROM quads GROUP BY patch_id HAVING min(least(z00, z01, z10, z11)) < 1000 AND max(greatest(z00, z01, z10, z11)) >= 0""",
    ),
    "patch_erosion": (
        patch_erosion,
        f"WITH {CELLS_SQL} SELECT a.patch_id, count(*) AS n_cells FROM cells a WHERE (SELECT count(*) FROM cells b WHERE b.patch_id = a.patch_id AND abs(b.i - a.i) + abs(b.j - a.j) = 1) = 4 GROUP BY a.patch_id",
    ),
    "patch_lift": (
        patch_lift,
        f"WITH {CELLS_SQL} SELECT c.patch_id, c.i + 2.5e-1 AS fi, c.j + 7.5e-1 AS fj, "
        + ", ".join(f"round(coalesce(({k}00 * 2.5e-1 + {k}01 * 7.5e-1) * 7.5e-1 + ({k}10 * 2.5e-1 + {k}11 * 7.5e-1) * 2.5e-1, -1), 9) AS {k}" for k in "xyz")
        + ", x00 IS NOT NULL AS valid FROM cells c LEFT JOIN quads q ON q.patch_id = c.patch_id AND q.i = c.i AND q.j = c.j",
    ),
    "patch_triangles": (
        patch_triangles,
        f"""WITH {CELLS_SQL} SELECT patch_id, i, j, 0 AS side, round((x10 + x00 + x01) / 3, 6) AS cx, round((z10 + z00 + z01) / 3, 6) AS cz FROM quads
UNION ALL SELECT patch_id, i, j, 1, round((x10 + x01 + x11) / 3, 6), round((z10 + z01 + z11) / 3, 6) FROM quads""",
    ),
    "quad_edges": (
        quad_edges,
        f"WITH {CELLS_SQL} SELECT a.patch_id, count(*) AS n_edges, round(sum(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))), 6) AS length FROM quads a JOIN quads b ON a.patch_id = b.patch_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.patch_id",
    ),
    "densify": (
        densified,
        f"""WITH {POINTS_SQL}, l AS (SELECT cid AS line_id, pid AS seq, CAST(pid % 7 AS DOUBLE) AS fi, CAST(pid % 5 AS DOUBLE) AS fj FROM points),
s AS (SELECT *, lead(fi) OVER w AS ni, lead(fj) OVER w AS nj FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
n AS (SELECT *, CASE WHEN ni IS NULL THEN 1 ELSE greatest(1, CAST(ceil(sqrt((ni - fi) * (ni - fi) + (nj - fj) * (nj - fj))) AS BIGINT)) END AS n FROM s),
x AS (SELECT line_id, CASE WHEN ni IS NULL THEN fi ELSE fi + (ni - fi) * (t / n) END AS fi FROM (SELECT *, unnest(range(n)) AS t FROM n))
SELECT line_id, count(*) AS n_samples, round(sum(fi), 6) AS sum_i FROM x GROUP BY line_id""",
    ),
    "path_transport": (
        path_transport,
        f"""WITH {CELLS_SQL}, t AS (SELECT patch_id || '/' || j AS line_id, i, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS th FROM cells),
d AS (SELECT *, th - lag(th) OVER (PARTITION BY line_id ORDER BY i) AS d FROM t)
SELECT line_id, count(*) AS n_valid, 0 AS n_dropped, CASE WHEN count(*) >= 2 THEN CAST(sum(CASE WHEN d < -pi() THEN 1 WHEN d > pi() THEN -1 ELSE 0 END) AS BIGINT) END AS delta FROM d GROUP BY line_id""",
    ),
    "edge_distance": (
        edge_distance,
        f"""WITH {CELLS_SQL}, box AS (SELECT patch_id, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM quads GROUP BY patch_id),
lat AS (SELECT patch_id, i, j FROM box, range(-2, 24) AS a(i), range(-2, 34) AS b(j) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1),
un AS (SELECT * FROM lat ANTI JOIN quads USING (patch_id, i, j))
SELECT q.patch_id, q.i, q.j, round(sqrt(min((q.i - u.i) * (q.i - u.i) + (q.j - u.j) * (q.j - u.j))), 9) AS distance FROM quads q JOIN un u USING (patch_id) GROUP BY ALL""",
    ),
    "integrability": (
        integrability,
        f"""WITH RECURSIVE {CELLS_SQL}, c AS (SELECT patch_id, i, j, {_theta("x", INNER_AXIS)} AS t, {_theta("k", INNER_AXIS)} AS k FROM
  (SELECT patch_id, i, j, (x00 + x01 + x10 + x11) / 4 AS xx, (y00 + y01 + y10 + y11) / 4 AS xy, x00 AS kx, y00 AS ky FROM quads)),
st(di, dj) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)),
ed AS (SELECT a.patch_id, a.i AS ia, a.j AS ja, b.i AS ib, b.j AS jb, di * dj <> 0 AND m.k IS NULL AS missed,
  CASE WHEN di * dj = 0 OR m.k IS NULL THEN {_cut("a.t", "b.t")} ELSE {_cut("a.t", "m.k")} + {_cut("m.k", "b.t")} END AS o
  FROM c a JOIN st ON true JOIN c b ON b.patch_id = a.patch_id AND b.i = a.i + di AND b.j = a.j + dj LEFT JOIN c m ON m.patch_id = a.patch_id AND m.i = a.i + 1 AND m.j = greatest(a.j, b.j)),
bw AS (SELECT patch_id, ia, ja, ib, jb, o FROM ed UNION ALL SELECT patch_id, ib, jb, ia, ja, -o FROM ed),
tri AS (SELECT p.patch_id, least(p.ia, q.ia, r.ia) AS i, least(p.ja, q.ja, r.ja) AS j, p.o + q.o + r.o AS s FROM bw p JOIN bw q ON q.patch_id = p.patch_id AND q.ia = p.ib AND q.ja = p.jb AND (q.ib, q.jb) > (p.ib, p.jb) AND (p.ib, p.jb) > (p.ia, p.ja)
  JOIN bw r ON r.patch_id = p.patch_id AND r.ia = q.ib AND r.ja = q.jb AND r.ib = p.ia AND r.jb = p.ja),
blk AS (SELECT a.patch_id, a.i, a.j FROM c a JOIN c b ON b.patch_id = a.patch_id AND b.i = a.i AND b.j = a.j + 1 JOIN c d ON d.patch_id = a.patch_id AND d.i = a.i + 1 AND d.j = a.j JOIN c e ON e.patch_id = a.patch_id AND e.i = a.i + 1 AND e.j = a.j + 1),
box AS (SELECT patch_id, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM c GROUP BY patch_id),
un AS (SELECT patch_id, i, j, i IN (i0, i1) OR j IN (j0, j1) AS rim FROM box, range(-2, 24) AS a(i), range(-2, 34) AS b(j) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 AND (patch_id, i, j) NOT IN (SELECT patch_id, i, j FROM c)),
far(patch_id, i, j) AS (SELECT patch_id, i, j FROM un WHERE rim UNION SELECT u.patch_id, u.i, u.j FROM far f JOIN un u ON u.patch_id = f.patch_id AND abs(u.i - f.i) + abs(u.j - f.j) = 1),
ins AS (SELECT * FROM un ANTI JOIN far USING (patch_id, i, j)),
hc(patch_id, i, j, x, y) AS (SELECT patch_id, i, j, i, j FROM ins UNION SELECT h.patch_id, h.i, h.j, u.i, u.j FROM hc h JOIN ins u ON u.patch_id = h.patch_id AND abs(u.i - h.x) + abs(u.j - h.y) = 1),
hl AS (SELECT patch_id, i, j, min(x * 1000 + y) AS hole FROM hc GROUP BY ALL),
ns(x, y, a, b) AS (VALUES (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0), (1, 0, 0, 1)),
go AS (SELECT h.patch_id, hole, b.o FROM hl h JOIN ns ON true JOIN bw b ON b.patch_id = h.patch_id AND b.ia = h.i + x AND b.ja = h.j + y AND b.ib = h.i + a AND b.jb = h.j + ns.b
  UNION ALL SELECT h.patch_id, h.hole, b.o FROM hl h JOIN ns ON true JOIN hl g ON g.patch_id = h.patch_id AND g.i = h.i + a AND g.j = h.j + ns.b
  JOIN bw b ON b.patch_id = h.patch_id AND b.ia = h.i + x AND b.ja = h.j + y AND b.ib = g.i + x AND b.jb = g.j + y),
rot AS (SELECT patch_id, hole, sum(o) AS s FROM go GROUP BY ALL),
n AS (SELECT patch_id, count(*) AS n_quads, (SELECT count(*) FROM ed WHERE ed.patch_id = c.patch_id) AS n_edges, (SELECT count(*) FROM tri WHERE tri.patch_id = c.patch_id) AS n_tri,
  (SELECT count(*) FROM blk WHERE blk.patch_id = c.patch_id) AS n_blk, (SELECT count(DISTINCT hole) FROM hl WHERE hl.patch_id = c.patch_id) AS n_holes FROM c GROUP BY patch_id)
SELECT patch_id, n_quads, n_quads - n_edges + n_tri - n_blk + n_holes AS n_components, n_edges, n_holes,
  (SELECT count(*) FROM rot WHERE rot.patch_id = n.patch_id AND s <> 0) + (SELECT count(DISTINCT (i, j)) FROM tri WHERE tri.patch_id = n.patch_id AND s <> 0) AS n_inconsistent,
  greatest((SELECT coalesce(max(abs(s)), 0) FROM tri WHERE tri.patch_id = n.patch_id), (SELECT coalesce(max(abs(s)), 0) FROM rot WHERE rot.patch_id = n.patch_id))::BIGINT AS max_residual,
  (SELECT count(*) FILTER (missed) FROM ed WHERE ed.patch_id = n.patch_id) AS invalid_midpoints FROM n""",
    ),
    "strip_deltas": (
        strip_deltas,
        f"""WITH {CELLS_SQL}, c AS (SELECT patch_id, i, j, (y00 + y01 + y10 + y11) / 4 >= 15 AS up FROM quads)
SELECT CAST(substr(c.patch_id, 2) AS BIGINT) * 600 + c.i * 30 + c.j AS request, CAST(c.up AS BIGINT) - CAST(s.up AS BIGINT) AS delta FROM c JOIN c s ON s.patch_id = c.patch_id AND s.i = 4 AND s.j = 12""",
    ),
    "measured_edges": (measured_edges, f"WITH {MEASURED_SQL} SELECT from_patch, to_patch, cid, pid_from, pid_to, delta, gap_from, gap_to, CAST(delta + gap_from + gap_to + sf - st AS BIGINT) AS measured FROM me"),
    "corrected_reach": (
        corrected_reach,
        f"""WITH RECURSIVE {MEASURED_SQL},
bw AS (SELECT from_patch AS x, to_patch AS y, delta AS o, gap_from + gap_to AS c, row(cid, pid_from, pid_to) AS w FROM me UNION ALL SELECT to_patch, from_patch, -delta, -gap_from - gap_to, row(cid, pid_from, pid_to) FROM me),
lv(x, d) AS (SELECT min(from_patch), 0 FROM me UNION SELECT bw.y, d + 1 FROM lv JOIN bw ON bw.x = lv.x WHERE d < 60),
ds AS (SELECT x, min(d) AS d FROM lv GROUP BY x),
tr AS (SELECT c.x, min(row(bw.x, bw.o)) AS up FROM ds c JOIN bw ON bw.y = c.x JOIN ds p ON p.x = bw.x AND p.d = c.d - 1 GROUP BY c.x),
tg AS (SELECT tr.x, up[1] AS via, up[2] AS o, arg_min(bw.c, bw.w) AS c FROM tr JOIN bw ON bw.x = up[1] AND bw.y = tr.x AND bw.o = up[2] GROUP BY ALL),
an(x, y, o, c) AS (SELECT x, x, 0::BIGINT, 0::BIGINT FROM ds UNION ALL SELECT an.x, via, an.o + tg.o, an.c + tg.c FROM an JOIN tg ON tg.x = an.y)
SELECT ds.x AS patch_id, CAST(d AS INT) AS hops, an.o AS uncorrected, an.o + an.c AS corrected FROM ds JOIN an ON an.x = ds.x WHERE an.y NOT IN (SELECT x FROM tg)""",
    ),
    "projection": (projection, f"WITH {PROJECTION_SQL} SELECT pid, patch_id, round(distance, 6) AS distance FROM hits"),
    "attachment": (
        attachment,
        f"""WITH {PROJECTION_SQL}, ar AS (SELECT patch_id, count(*) AS area FROM quads GROUP BY patch_id), m AS (SELECT pid, min(row(-area, distance, patch_id)) AS m FROM hits JOIN ar USING (patch_id) GROUP BY pid)
SELECT pid, m[3] AS patch_id, round(m[2], 6) AS distance FROM m""",
    ),
    "hit_gate": (
        hit_gate,
        f"WITH {ATTACHED_SQL}, g AS (SELECT cid, r < 600 AND count(*) FILTER (r < 600) OVER w >= least(3, count(*) OVER w) AS gated FROM att WINDOW w AS (PARTITION BY cid ORDER BY pid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT cid, count(*) FILTER (gated) AS n_gated FROM g GROUP BY cid",
    ),
    "relative_edges": (relative_edges, f"WITH {RELATIVE_SQL} SELECT * FROM rel"),
    "patch_reach": (patch_reach, f"WITH RECURSIVE {REACH_SQL} SELECT * FROM rd"),
    "patch_loops": (patch_loops, f"WITH RECURSIVE {REACH_SQL} SELECT h AS holonomy, count(*) AS n_loops FROM lp GROUP BY h"),
    "loop_cycles": (
        loop_cycles,
        f"""WITH RECURSIVE {REACH_SQL}, mt AS (SELECT lp.x, lp.y, lp.o, h, min(row(p.k, p.y, q.k)) AS m FROM lp JOIN an p ON p.x = lp.x JOIN an q ON q.x = lp.y AND q.y = p.y WHERE h <> 0 GROUP BY ALL),
wy AS (SELECT mt.x, mt.y, mt.o, h, m, p.k AS seq, p.y AS n FROM mt JOIN an p ON p.x = mt.x AND p.k <= m[1] UNION ALL SELECT mt.x, mt.y, mt.o, h, m, m[1] + m[3] - q.k, q.y FROM mt JOIN an q ON q.x = mt.y AND q.k < m[3]),
sp AS (SELECT a.x, a.y, a.o, a.h, a.m, a.seq, a.n AS f, b.n AS t, rt.winding - rf.winding AS delta, 'tree' AS kind FROM wy a JOIN wy b ON b.x = a.x AND b.y = a.y AND b.o = a.o AND b.seq = a.seq + 1 JOIN rd rf ON rf.patch_id = a.n JOIN rd rt ON rt.patch_id = b.n
  UNION ALL SELECT x, y, o, h, m, m[1] + m[3], y, x, -o, 'closing' FROM mt),
st AS (SELECT sp.*, w FROM sp JOIN wi ON wi.x = sp.f AND wi.y = sp.t AND wi.o = sp.delta)
SELECT st.x AS from_patch, st.y AS to_patch, st.o AS loop_delta, st.h AS residual, m[2] AS lca, st.seq, f AS patch_id, t AS next_patch, delta, kind, w[1] AS cid, w[2] AS pid_from, w[3] AS pid_to,
  coalesce(lag(w[3]) OVER c, last_value(w[3]) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pid_in FROM st WINDOW c AS (PARTITION BY st.x, st.y, st.o ORDER BY seq)""",
    ),
    "anchor_votes": (
        anchor_votes,
        f"""WITH RECURSIVE {REACH_SQL}, v AS (SELECT root, CAST(wind_a AS BIGINT) - winding AS vote, count(*) AS n FROM att JOIN rd USING (patch_id) WHERE kind = 'absolute' GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY root) = 1 AS agreed FROM v""",
    ),
    "disconnected_subgraphs": (
        disconnected_subgraphs,
        f"""WITH RECURSIVE {RELATIVE_SQL}, ar AS (SELECT patch_id, CAST(count(*) AS DOUBLE) AS area FROM att WHERE patch_id IS NOT NULL GROUP BY patch_id),
bo AS (SELECT from_patch AS x, to_patch AS y FROM rel UNION SELECT to_patch, from_patch FROM rel),
rc(x, y) AS (SELECT patch_id, patch_id FROM ar UNION SELECT rc.x, bo.y FROM rc JOIN bo ON rc.y = bo.x),
lb AS (SELECT x AS patch_id, min(y) AS component FROM rc GROUP BY x),
rk AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY area DESC, patch_id) AS i FROM lb JOIN ar USING (patch_id)),
g AS (SELECT component, count(*) AS n_patches, sum(area) AS total_area, string_agg(patch_id, ',' ORDER BY i) FILTER (i <= 5) AS top_patches FROM rk GROUP BY component)
SELECT *, row_number() OVER (ORDER BY n_patches DESC, total_area DESC, component) AS place FROM g""",
    ),
    "nearest_links": (nearest_links, f"WITH {OFFERS_SQL} SELECT pid, arg_min(patch_id, (distance, patch_id)) AS patch_id, round(min(distance), 9) AS distance FROM gt WHERE fair GROUP BY pid"),
    "largest_links": (
        largest_links,
        f"""WITH {OFFERS_SQL}, b AS (SELECT pid, min(row(CASE WHEN paired THEN 0 ELSE -area END, distance, patch_id)) AS m FROM gt JOIN ara USING (patch_id) WHERE fair GROUP BY pid)
SELECT pid, m[3] AS patch_id, round(m[2], 9) AS distance FROM b""",
    ),
    "new_patch_gains": (
        new_patch_gains,
        f"""WITH {OFFERS_SQL}, old AS (SELECT DISTINCT pid FROM gt WHERE fair AND patch_id LIKE 'r%'),
up AS (SELECT cid, pid, kind, row_number() OVER (PARTITION BY cid ORDER BY pid) AS i, count(*) OVER (PARTITION BY cid) AS n FROM points WHERE kind <> 'absolute' OR wind_a > 0 OR pid IN (SELECT pid FROM old)),
nw AS (SELECT al.pid, al.patch_id, up.cid, up.i, up.n FROM al JOIN up USING (pid) WHERE patch_id NOT LIKE 'r%'),
ok AS (SELECT DISTINCT cid, pid FROM nw a WHERE (SELECT count(*) FROM nw b WHERE b.cid = a.cid AND b.patch_id = a.patch_id AND abs(b.i - a.i) <= 2) >= least(3, least(a.i + 2, a.n) - greatest(a.i - 2, 1) + 1))
SELECT cid, count(*) AS gained FROM ok WHERE pid NOT IN (SELECT pid FROM old) GROUP BY cid""",
    ),
    "named_pairs": (named_pairs, f"WITH {RELATIVE_SQL} SELECT DISTINCT 'between_patches__' || from_patch || '__' || to_patch AS name, from_patch AS \"first\", to_patch AS \"second\" FROM rel"),
    "incremental_links": (incremental_links, f"WITH {ATTACHED_SQL} SELECT cid, count(*) FILTER (patch_id IS NOT NULL OR r < 500) AS n_attached FROM att GROUP BY cid"),
    "collection_round_trip": (
        collection_round_trip,
        ROUND_TRIP_SQL,
    ),
    "sharded_round_trip": (sharded_round_trip, ROUND_TRIP_SQL),
}
