"""Reports of an audit: sites, censuses, frames, certificates, ranks."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import controls, patches, report
from plumbline.operators.graph import feasible, fundamental_cycles, negative_cycles
from plumbline.operators.ranking import placed

LINK = "akey string, bkey string, a string, b string, pid_a long, pid_b long, offset long, gap double"


def chain(kind, cid, n):
    return [(kind, f"{kind}:{cid}", 100 * cid + k) for k in range(n)]


def links_of(spark, rows):
    return spark.createDataFrame([(a, b, a, b, p, q, o, g) for a, b, p, q, o, g in rows], LINK)


def test_sites_beside_the_chain(spark):
    # relative:1 of 6 points meets absolute:7 on its left and absolute:8 on its right; an
    # equation between the two makes the boundaries in between reachable
    nodes = spark.createDataFrame(chain("relative", 1, 6) + chain("same", 2, 4) + chain("same", 3, 3), "kind string, nkey string, pid long")
    rows = [("absolute:7", "relative:1", 900 + k, 100 + k, 0, 0.0) for k in (0, 1)]
    rows += [("absolute:8", "relative:1", 950 + k, 100 + k, 0, 0.0) for k in (4, 5)]
    # same:2 meets a trace that isn't among the equations at all its points
    rows += [("same:2", "same:9", 200 + k, 970 + k, 0, 0.0) for k in range(4)]
    edge = lambda a, b: (a, b, 0, 2)
    schema = "akey string, bkey string, offset long, support long"
    joined = spark.createDataFrame([edge("absolute:7", "absolute:8"), edge("absolute:7", "relative:1"), edge("absolute:8", "relative:1")], schema)
    found = {(r["nkey"], r["boundary"]): (r["n_left"], r["n_right"], r["reachable"]) for r in report.boundary_sites(nodes, links_of(spark, rows), joined, 2).collect()}
    assert [found["relative:1", b] for b in range(1, 6)] == [(0, 1, False), (1, 1, True), (1, 1, True), (1, 1, True), (1, 0, False)]
    assert [found["same:2", b] for b in (1, 2, 3)] == [(0, 1, False), (1, 1, False), (1, 0, False)]
    assert len(found) == 8
    apart = spark.createDataFrame([edge("absolute:7", "relative:1"), edge("absolute:8", "relative:1")], schema)
    assert not report.boundary_sites(nodes, links_of(spark, rows), apart, 2).where("reachable").count()
    # a trace that hangs on a labelled node, though not by an equation with the chain itself
    tied = spark.createDataFrame([edge("relative:5", "same:9")], schema)
    assert {r["boundary"] for r in report.boundary_sites(nodes, links_of(spark, rows), tied, 2).where("reachable").collect()} == {2}


def test_sites_of_nothing(spark):
    none = spark.createDataFrame([], "kind string, nkey string, pid long")
    edges = spark.createDataFrame([], "akey string, bkey string, offset long, support long")
    assert report.boundary_sites(none, links_of(spark, []), edges, 2).count() == 0


def test_band_census(spark):
    rows = [("a", "b", 1, 2, 0, 1.0), ("a", "b", 3, 4, 0, 6.0), ("c", "d", 5, 6, 1, 6.0), ("c", "d", 7, 8, 1, -6.5), ("e", "f", 1, 1, 0, 1.0), ("e", "f", 2, 2, 0, 2.0)]
    edges = spark.createDataFrame([("a", "b", 0), ("c", "d", 1), ("e", "f", 0)], "akey string, bkey string, offset long")
    assert tuple(report.band_census(links_of(spark, rows), edges, 20.0, 2).first()) == (6, 3, 2, 1, 1)


def test_exposure(spark):
    e = report.cut_exposure(spark.createDataFrame([(0.1, 6.2), (1.0, 1.5)], "a double, b double"), "a", "b").first()
    w = [0.1 - 6.2 + 2 * math.pi, 0.5]
    assert e["n_gaps"] == 2 and e["max_width"] == pytest.approx(0.5) and e["expected"] == pytest.approx(sum(w) / (2 * math.pi))
    assert e["probability"] == pytest.approx(1 - math.exp(-sum(w) / (2 * math.pi)))
    assert report.cut_exposure(spark.createDataFrame([], "a double, b double"), "a", "b").first()["probability"] == 0


def test_gauges(spark):
    # node n's first point moves over the cut, node m's doesn't: offsets change by the gauge
    points = spark.createDataFrame([("n", 1, 6.2), ("n", 2, 6.25), ("m", 3, 3.0)], "nkey string, pid long, theta double")
    turned = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.15), (3, 0, 3.1)], "pid long, label long, theta double")
    rows = [("m", "n", 3, 1, 1, 0.0), ("m", "n", 3, 2, 1, 0.0)]
    fair = report.gauge_differences(links_of(spark, rows), points, turned, 1).first()
    # label 0 - 0 and angles 3.1 to 0.1 cross nothing by the short way, so offsets of 1 become 0
    assert (fair["n_links"], fair["n_changed"], fair["n_off"]) == (2, 2, 2)
    shifted = turned.withColumn("label", F.when(F.col("pid") == 3, 2).otherwise(0).cast("long"))
    assert report.gauge_differences(links_of(spark, rows), points, shifted, 1).first()["n_off"] == 0


def test_negative_cycle_is_shown(spark):
    frame = lambda rows: spark.createDataFrame(rows, "u string, v string, bound long, grp string")
    arcs = [("a", "b", 1, "g1"), ("b", "c", -2, "g2"), ("c", "a", 0, "g3"), ("c", "d", 5, "g4"), ("x", "y", -1, "g5"), ("y", "x", 0, "g6"), ("y", "x", 3, "g7")]
    ok, dist = feasible(frame(arcs))
    found = negative_cycles(frame(arcs), dist).collect()
    assert not ok and {(r["u"], r["v"], r["bound"], r["grp"]) for r in found} <= set(arcs)
    for _, of in itertools.groupby(sorted(found, key=lambda r: r["cycle"]), key=lambda r: r["cycle"]):
        of = list(of)
        assert sum(r["bound"] for r in of) == of[0]["total"] < 0
        assert sorted(r["u"] for r in of) == sorted(r["v"] for r in of)
    ok, dist = feasible(frame(arcs[3:4]))
    assert ok and negative_cycles(frame(arcs[3:4]), dist).count() == 0


def test_certificates_close_and_add_up(spark):
    rows = [("a", "b", 1, 2), ("b", "c", 1, 2), ("a", "c", 5, 3), ("c", "d", 0, 2), ("p", "q", 1, 2)]
    edges = spark.createDataFrame(rows, "akey string, bkey string, offset long, support long")
    cycles = fundamental_cycles(edges)
    steps = sorted(report.cycle_certificates(cycles, edges).collect(), key=lambda r: r["seq"])
    assert len(steps) == 3 and abs(sum(r["contribution"] for r in steps)) == 3
    assert all(x["to_key"] == y["from_key"] for x, y in zip(steps, [*steps[1:], steps[0]], strict=True))
    closing = (steps[0]["akey"], steps[0]["bkey"])
    links = links_of(spark, [("a", "b", 1, 2, 1, 0.0), ("b", "c", 1, 2, 1, 0.0), ("a", "c", 1, 2, 5, 0.0), ("c", "d", 1, 2, 0, 0.0)])
    assert [(r["akey"], r["bkey"]) for r in report.cycle_witnesses(cycles, links).collect()] == [closing]


def test_implicated(spark):
    conflicts = spark.createDataFrame([("a", "b"), ("a", "c")], "akey string, bkey string")
    chosen = spark.createDataFrame([("a",), ("z",)], "nkey string")
    assert {tuple(r) for r in report.implicated_nodes(conflicts, chosen).collect()} == {("a", True, True), ("b", True, False), ("c", True, False), ("z", False, True)}


def test_summaries(spark):
    audited = spark.createDataFrame([("0#n", 3, 1, 0), ("1#n", 3, 3, 0), ("-1#n", 3, 0, 1), ("0#m", 1, 0, 0), ("1#m", 1, 0, 0)], "node string, n_pairs long, n_sign long, n_split long")
    got = {r["scenario"]: tuple(r)[1:] for r in controls.planted_summary(audited).collect()}
    assert got == {1: (2, 1, 0.5, 2.0), -1: (1, 0, 0.0, None)}
    null = spark.createDataFrame([(1, 5, 3), (2, 5, 0)], "scenario int, n_pairs long, n_violations long")
    n = controls.null_summary(null, 2).first()
    assert (n["n_rounds"], n["n_alarms"], n["share"]) == (2, 1, 0.5) and n["low"] < 0.05 and n["high"] > 0.95


def test_places_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), "id").repartition(7)
    got = [(r["k"], r["id"]) for r in placed(rows, [F.col("k").desc(), F.col("id")], "place").orderBy("place").collect()]
    assert got == sorted(((k % 37, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))
    assert placed(rows.limit(0), [F.col("k")], "place").count() == 0


def test_triangle_distance_against_samples(spark):
    tri = ((0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 3.0, 0.0))
    flat = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0))
    places = [(1.0, 1.0, 2.0), (-3.0, -4.0, 0.0), (5.0, 5.0, 1.0), (2.0, -1.0, 0.5), (0.0, 0.0, 0.0)]
    t = "struct<x:double,y:double,z:double>"
    rows = spark.createDataFrame([(10 * m + k, p, *abc) for m, abc in enumerate((tri, flat)) for k, p in enumerate(places)], f"k int, p {t}, a {t}, b {t}, c {t}")
    got = {r["k"]: r["distance"] for r in patches.with_triangle_distance(rows).collect()}
    n = 200
    for m, (a, b, c) in enumerate((tri, flat)):
        for k, p in enumerate(places):
            least = min(math.dist(p, [a[d] + i / n * (b[d] - a[d]) + j / n * (c[d] - a[d]) for d in range(3)]) for i in range(n + 1) for j in range(n + 1 - i))
            assert got[10 * m + k] == pytest.approx(least, abs=0.02)
