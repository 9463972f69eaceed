"""Steps whose work or memory must not outgrow their input."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import audit, components, graph, matching, settings
from plumbline.operators.components import durable
from plumbline.plans import audit_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_within_nodes_are_not_broadcast(spark):
    rows = [(f"relative:{k // 5}", k, 0.01 * (k % 5), 100.0 + k % 7, 5.0 * (k % 5), 0) for k in range(40)]
    # files as small as these are broadcast, and their size tells nothing of rows that are exploded
    p = durable(spark.createDataFrame(rows, "nkey string, pid long, theta double, r double, z double, label long"), "points")
    sloped = audit.with_slopes(p)
    assert "BroadcastHashJoin [nkey" not in plan(audit._within_node(p, 10.0, ["r", "z"]))
    assert sloped.where("slope is not null").count() == 40


def test_calibration_meets_places_not_copies(spark):
    """Copies of points weigh in; they don't make pairs of their own."""
    rng = np.random.default_rng(2)
    places = [(float(t), float(100 + 20 * w + d), float(z), float(w)) for t, d, z, w in zip(rng.uniform(0, 0.5, 60), rng.uniform(-3, 3, 60), rng.uniform(0, 40, 60), rng.integers(0, 5, 60), strict=True)]
    rows = [(100 * c + k, "absolute", *p) for k, p in enumerate(places) for c in range(1 + k % 4)]
    p = spark.createDataFrame(rows, "pid long, kind string, theta double, r double, z double, wind_a double")
    near = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if abs(a[4] - b[4]) <= 20 and abs(a[2] - b[2]) <= settings.CALIB_DTHETA and a[5] != b[5]]
    spacing = [abs(a[3] - b[3]) / abs(a[5] - b[5]) for a, b in near]
    got = settings.calibration(p, dz=20.0).first()
    assert got["n_calibration_pairs"] == len(near)
    assert [got[f"wrap_spacing_{c}"] for c in ("median", "p10", "p90")] == pytest.approx(np.percentile(spacing, [50, 10, 90]).tolist())
    assert got["anchor_order_agreement"] == pytest.approx(np.mean([(a[3] - b[3]) * (a[5] - b[5]) > 0 for a, b in near]))
    assert settings.anchor_pairs(p, dz=20.0).count() <= 60 * 59 / 2 < len(near)
    none = settings.calibration(p.limit(0)).first()
    assert (none["n_calibration_pairs"], none["wrap_spacing_median"], none["anchor_order_agreement"]) == (0, None, None)


def test_pairs_carry_only_what_is_asked_of_them(spark):
    rows = [(f"same:{k % 3}", f"same:{k % 3}", k, 0.01 * k, 100.0, 1.0, 7, None, 0, 0) for k in range(6)]
    cells = durable(spark.createDataFrame(rows, "nkey string, node string, pid long, theta double, r double, z double, label long, slope double, zi long, ti long"), "cells")
    pairs = matching.band_pairs(cells, settings.FIXTURE, None)
    assert "label" not in plan(pairs.select("a.pid", F.col("b.pid").alias("other")))
    assert all(r["a"]["nkey"] < r["b"]["nkey"] for r in pairs.collect()) and pairs.count() == 12


def test_only_nodes_with_several_points_are_dealt_by_centre(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"same:{k // 6}" if k < 120 else f"same:x{k}", k, float(t), float(100 + 7 * d), float(z), int(w), None if k % 3 else 0.1, int(z // 10), int(t / 6.283185307179586 * 90)) for k, (t, d, z, w) in enumerate(zip(rng.uniform(0, 1, 400), rng.uniform(0, 9, 400), rng.uniform(0, 40, 400), rng.integers(0, 3, 400), strict=True))]
    cells = spark.createDataFrame(rows, "nkey string, pid long, theta double, r double, z double, label long, slope double, zi long, ti long")
    want = matching.crowding(matching.referred(cells, settings.FIXTURE), settings.FIXTURE).groupBy("cz", "ct").agg(F.max("crowded").alias("vetoed"))
    dealt, crowding = [], matching.crowding
    monkeypatch.setattr(matching, "crowding", lambda hood, cfg, *more: dealt.append(hood) or crowding(hood, cfg, *more))
    got = matching.crowded_centres(cells, settings.FIXTURE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r["vetoed"] for r in want.collect()} == {True, False}
    assert not dealt[0].where("nkey like 'same:x%'").count() and dealt[0].count() <= 5 * 120


def test_labels_of_components_are_not_broadcast(spark, monkeypatch):
    rows = [(f"n{k:03}", f"n{k + 1:03}") for k in range(40) if k % 10 != 9]
    edges = spark.createDataFrame(rows, "a string, b string")
    nodes = spark.createDataFrame([(f"n{k:03}",) * 2 for k in range(40)], "node string, label string")
    plans, write = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, name: plans.append(plan(df)) or write(df, name))
    got = components.connected_components(nodes, edges)
    assert {r["node"]: r["label"] for r in got.collect()} == {f"n{k:03}": f"n{k // 10 * 10:03}" for k in range(40)}
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def copied_points(copies, seed=3):
    """Points of 20 nodes near each other, each node several times; the last ones differ in a label."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(20):
        own = [(float(rng.uniform(0, 0.4)), float(100 + rng.integers(0, 9) * 10), float(rng.integers(0, 3) * 10), int(rng.integers(0, 3)), None if rng.random() < 0.7 else 0.1) for _ in range(5)]
        own.append(own[0])
        for c in range(copies if k % 4 else 1):
            odd = c == 3 and k % 8 == 1
            rows += [(f"same:{c}.{k:02}", f"n{c}.{k:02}", 1000 * k + 10 * c + i, t, r, z, w + (odd and i == 5), s, int(z // 10), int(t / 6.283185307179586 * 90), True) for i, (t, r, z, w, s) in enumerate(own)]
    return rows, "nkey string, node string, pid long, theta double, r double, z double, label long, slope double, zi long, ti long, seam_safe boolean"


def test_order_meets_classes_of_nodes_not_copies(spark, monkeypatch):
    rows, schema = copied_points(4)
    cells = durable(spark.createDataFrame(rows, schema), "cells")
    pairs, found = matching.candidate_pairs(cells, settings.FIXTURE, None), matching.links(cells, settings.FIXTURE)
    want = sorted(map(tuple, pairs.groupBy(F.col("a.node"), F.col("b.node")).agg(F.count(F.lit(1)), F.count_if(F.abs("gap") > 20.0)).collect()))
    arcs = sorted(map(tuple, graph.order_arcs(pairs, found, 20.0, 1.0, 2).collect()))
    compared, compare = [], matching.compared
    monkeypatch.setattr(matching, "compared", lambda p, cfg: compared.append(p) or compare(p, cfg))
    monkeypatch.setattr(audit_queries, "cells", lambda *_: cells)
    assert sorted(map(tuple, audit_queries.order_candidates(spark, "").collect())) == want
    assert sorted(map(tuple, audit_queries.order_arcs(spark, "").collect())) == arcs and len(arcs) > 200
    assert compared[0].count() < pairs.count() / 2  # a first and a second node a class, of four


def test_classes_need_equal_places_not_equal_hashes(spark, monkeypatch):
    rows, schema = copied_points(4)
    cells = spark.createDataFrame(rows, schema)
    named = {r["nkey"]: r["cls"] for r in matching.node_classes(cells).collect()}
    assert named["same:2.02"] == "same:0.02" and named["same:3.01"] == "same:3.01" and named["same:0.04"] == "same:0.04"
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert {r["nkey"]: r["cls"] for r in matching.node_classes(cells).collect() if r["cls"] != r["nkey"]}.items() <= named.items()


def test_far_parents_are_written_seldom(spark, monkeypatch):
    rows = [(f"n{k:03}", f"n{(k + 1) % 40:03}") for k in range(40)]
    now, written, write = spark.createDataFrame(rows, "node string, parent string"), [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: written.append(name) or write(df, name))
    far = {r["node"]: r["up"] for r in graph._far_parents(now, 40).collect()}
    assert far == {f"n{k:03}": f"n{(k + 64) % 40:03}" for k in range(40)} and len(written) <= 2


def test_margins_meet_classes_of_nodes_not_copies(spark, monkeypatch):
    rows, schema = copied_points(4)
    cells = durable(spark.createDataFrame(rows, schema), "cells")
    pairs, found = matching.candidate_pairs(cells, settings.FIXTURE, None), matching.links(cells, settings.FIXTURE)
    want = graph.margin_grid(pairs, found, 20.0, audit_queries.MARGINS, 2).collect()
    compared, compare = [], matching.compared
    monkeypatch.setattr(matching, "compared", lambda p, cfg: compared.append(p) or compare(p, cfg))
    monkeypatch.setattr(audit_queries, "cells", lambda *_: cells)
    got = audit_queries.margin_grid(spark, "").collect()
    assert got == want
    classes = matching.node_classes(cells)
    first = matching.of_first_nodes(cells, classes)
    few, linked = matching.candidate_pairs(first, settings.FIXTURE, None, ordered=False), lambda p: matching.as_links(p.where(F.abs("gap") <= 7.0))
    grids = [graph.margin_grid(p, linked(p), 20.0, [1.0, 2.0], 1, *more).collect() for p, *more in ((pairs,), (few, classes))]
    assert grids[0] == grids[1] and grids[0][0]["n_conflicts"] > 0
    assert compared[0].count() < pairs.count() / 3  # the first nodes of classes, and a first with its second


def test_cycles_are_sought_among_two_nodes_of_a_class(spark, monkeypatch):
    rows, schema = copied_points(4)
    cells = durable(spark.createDataFrame(rows, schema), "cells")
    every = graph.order_arcs(matching.candidate_pairs(cells, settings.FIXTURE, None), matching.links(cells, settings.FIXTURE), 20.0, 1.0, 2)
    monkeypatch.setattr(audit_queries, "cells", lambda *_: cells)
    bounds = audit_queries.class_bounds(spark, "")
    ok, dist = graph.feasible(every)
    assert (bounds.feasible(), bounds.n) == (ok, dist.count())
    columns = ["cycle", "u", "v", "bound", "grp", "total"]
    want = sorted(map(tuple, graph.all_negative_cycles(every).select(columns).collect()))
    assert sorted(map(tuple, bounds.negative_cycles().select(columns).collect())) == want and want
    assert bounds.arcs.count() < every.groupBy("u", "v").agg(F.min("bound")).count() / 2
