import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.geometry import cut_crossing, sense_sign, theta_cells, wrap_angle
from plumbline.operators import audit, controls, frame, graph, matching, settings
from tests.conftest import spiral

CFG = settings.AuditConfig(20.0, 18.0, 22.0, 100, 1.0, 7.0, 14.0)
SCHEMA = "cid long, pid long, kind string, theta double, r double, z double, wind_a double"


def ladder(cid, theta=1.0, z=0.0, wraps=range(1, 7), tilt=0.0, spacing=20.0):
    return [(cid, cid * 1000 + w, "relative", theta, spiral(w, theta, z, tilt, spacing), float(z), float(w)) for w in wraps]


def trace(cid, wrap, theta=1.0, zs=range(0, 40, 4), tilt=0.0, start=0):
    return [(cid, cid * 1000 + start + k, "same", theta, spiral(wrap, theta, z, tilt), float(z), None) for k, z in enumerate(zs)]


def nodes(spark, *rows):
    return frame.node_points(spark.createDataFrame([r for part in rows for r in part], SCHEMA))


def sloped(spark, *rows):
    return audit.with_slopes(nodes(spark, *rows))


def test_angles(spark):
    row = spark.range(1).select(*[wrap_angle(F.lit(x)).alias(f"a{k}") for k, x in enumerate((math.pi, -math.pi, 5.0))]).first()
    assert row[0] == math.pi and row[1] == pytest.approx(math.pi) and row[2] == pytest.approx(5 - 2 * math.pi)
    cut = lambda a, b: spark.range(1).select(cut_crossing(F.lit(a), F.lit(b))).first()[0]
    assert (cut(6.2, 0.1), cut(0.1, 6.2), cut(1.0, 2.0), cut(0.0, math.pi)) == (1, -1, 0, 0)
    assert sense_sign("acw") == -1 and theta_cells(math.radians(4)) == 90
    with pytest.raises(ValueError):
        sense_sign("up")


def test_clean_and_swapped_ladder(spark):
    v = lambda rows: audit.order_pairs(sloped(spark, rows), CFG).where("violation is not null").count()
    clean = ladder(1)
    assert v(clean) == 0
    a, b = clean[1], clean[3]
    assert v([a[:6] + (b[6],), b[:6] + (a[6],), *clean[:1], clean[2], *clean[4:]]) > 0


def test_steps_of_a_trace(spark):
    steps = lambda rows: audit.step_audit(nodes(spark, rows), CFG).where("violation").count()
    assert steps(trace(1, 3, tilt=0.4)) == 0
    jumped = trace(1, 3, zs=range(0, 20, 4)) + trace(1, 4, zs=range(20, 40, 4), start=5)
    assert steps(jumped) >= 1


def found_edges(spark, *rows):
    cells = matching.in_cells(sloped(spark, *rows), CFG)
    links = matching.links(cells, CFG)
    return matching.edges(links, CFG).collect(), matching.conflicts(links, CFG).collect(), cells


def test_ladder_and_trace_link(spark):
    edges, conflicts, _ = found_edges(spark, ladder(1), trace(2, 4))
    # one point of the ladder meets many of the trace
    assert [e["offset"] for e in edges] == [4] and not conflicts


def test_crowded_cells_are_vetoed(spark):
    edges, _, cells = found_edges(spark, ladder(1, spacing=8.0), trace(2, 2))
    assert not edges
    assert matching.crowded_centres(cells, CFG).where("vetoed").count() > 0


def test_single_link_makes_no_edge(spark):
    edges, conflicts, cells = found_edges(spark, ladder(1), trace(2, 4, zs=[0]))
    assert not edges and not conflicts
    s = matching.match_stats(cells, matching.crowded_centres(cells, CFG), matching.links(cells, CFG), CFG).first()
    assert s["n_unsupported_links"] == 1


def test_link_across_the_cut(spark):
    before, after = 2 * math.pi - 0.01, 0.01
    edges, _, cells = found_edges(spark, ladder(1, theta=before), trace(2, 5, theta=after, zs=range(0, 12, 2)))
    assert [e["offset"] for e in edges] == [4 + 1 - 0] or [e["offset"] for e in edges] == [5]
    assert matching.links(cells, CFG).where("over_cut").count() > 0


def test_trace_on_two_wraps_conflicts(spark):
    mixed = trace(2, 4, zs=range(0, 12, 2)) + trace(2, 5, zs=range(0, 12, 2), start=6)
    edges, conflicts, _ = found_edges(spark, ladder(1), mixed)
    assert not edges and [c["offsets"] for c in conflicts] == [[4, 5]]


def test_absolute_clusters(spark):
    near = [(1, 10 + k, "absolute", t, 100.0, 0.0, 1.0) for k, t in enumerate((0.05, 1.0, 1.05, 3.0, 3.05, 3.1))]
    got = nodes(spark, near).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("seam_safe").alias("safe")).collect()
    assert sorted(r["n"] for r in got) == [1, 2, 3] and sum(not r["safe"] for r in got) == 1


def test_planted_defects_are_seen(spark):
    n = nodes(spark, ladder(1, wraps=range(1, 9)))
    hits = controls.planted_order_audit(controls.plant_steps(n), CFG)
    assert hits.count() == 2
    rounds = controls.noise_null(n, CFG, 3).collect()
    assert {r["scenario"] for r in rounds} == {1, 2, 3}
    again = controls.noise_null(n.repartition(3), CFG, 3).collect()
    assert sorted(map(tuple, rounds)) == sorted(map(tuple, again))


def test_order_arcs_need_a_margin(spark):
    with pytest.raises(ValueError):
        graph.order_arcs(None, None, 20.0, 0.0, 2)


def test_calibration_needs_pairs(spark):
    p = spark.createDataFrame(ladder(1), SCHEMA).withColumn("kind", F.lit("absolute"))
    cfg = settings.calibrate(p)
    assert cfg.wrap_spacing_median == pytest.approx(20.0) and cfg.r_same == pytest.approx(7.0) and len(cfg.fingerprint) == 64
    with pytest.raises(ValueError):
        settings.calibrate(p.limit(2))


def test_no_angle_on_the_axis(spark):
    axis = spark.createDataFrame([(0.0, 5.0, -3.0), (100.0, 5.0, -3.0)], "z double, x double, y double")
    beside = spark.createDataFrame([(1, 5.0, -2.0, 50.0)], "pid long, x double, y double, z double")
    found = frame.axis_angles(beside, axis)
    assert dict(found.dtypes)["theta"] == "float" and abs(found.first()["theta"] - math.pi / 2) < 1e-6
    for y in (-3.0, float("nan"), None):
        nowhere = beside.withColumn("y", F.lit(y).cast("double"))
        with pytest.raises(Exception, match="no angle on the axis"):
            frame.axis_angles(beside.unionAll(nowhere), axis).collect()
