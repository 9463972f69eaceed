import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import linking, patch_graph, patches
from plumbline.plans import patch_queries
from plumbline.sources import collections as docs
from plumbline.sources.helix import axis_table

AXIS = [(-1000.0, 0.0, 0.0), (20000.0, 0.0, 0.0)]
CELLS = "patch_id string, i long, j long, x double, y double, z double"


def grid(spark, h, w, at, skip=()):
    return spark.createDataFrame([("p", i, j, *map(float, at(i, j))) for i in range(h) for j in range(w) if (i, j) not in skip], CELLS)


def test_ring_around_the_axis_is_one_crossing(spark):
    q = patches.quads(grid(spark, 9, 9, lambda i, j: (i - 4, j - 4, 0)))
    row = patches.integrability(q, axis_table(spark, AXIS)).first()
    assert row["n_inconsistent"] > 0  # the axis passes through the patch
    off = patches.quads(grid(spark, 9, 9, lambda i, j: (i + 10, j - 4, 0)))
    assert patches.integrability(off, axis_table(spark, AXIS)).first()["n_inconsistent"] == 0


def test_strip_across_the_cut_and_disconnected(spark):
    q = patches.quads(grid(spark, 5, 20, lambda i, j: (10 + i, j - 9.5, 0)))
    ask = spark.createDataFrame([(1, "p", 2.0, 1.0, 2.0, 17.0), (2, "p", 2.0, 17.0, 2.0, 1.0)], "request long, patch_id string, from_i double, from_j double, to_i double, to_j double")
    got = {r["request"]: r["delta"] for r in patches.strip_deltas(ask, q, axis_table(spark, AXIS)).collect()}
    assert got == {1: 1, 2: -1}
    gap = patches.quads(grid(spark, 5, 20, lambda i, j: (10 + i, j - 9.5, 0), {(i, 9) for i in range(5)}))
    assert {r["delta"] for r in patches.strip_deltas(ask, gap, axis_table(spark, AXIS)).collect()} == {None}


def quad_places(spark, places):
    c = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame([("p", i, j, *[(float(i), float(j), 0.0)] * 4) for i, j in places], f"patch_id string, i long, j long, c00 {c}, c01 {c}, c10 {c}, c11 {c}")


@pytest.mark.parametrize("h,w,full", [(9, 11, 0.8), (40, 150, 0.97), (3, 90, 1.0)])
def test_edge_distance_matches_brute_force(spark, h, w, full):
    rng = np.random.default_rng(2)
    mask = rng.random((h, w)) <= full
    empty = np.argwhere(~np.pad(mask, 1)) - 1
    want = {(i, j): np.sqrt(((empty - (i, j)) ** 2).sum(1).min()) for i, j in np.argwhere(mask).tolist()}
    got = {(r["i"] + 5, r["j"] - 70): r["distance"] for r in patches.edge_distance(quad_places(spark, [(i - 5, j + 70) for i, j in np.argwhere(mask).tolist()])).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def gate(spark, h, w, at, skip=()):
    return patches.integrability(patches.quads(grid(spark, h, w, at, skip)), axis_table(spark, AXIS)).first()


def test_hole_around_the_axis_fails_by_one(spark):
    row = gate(spark, 11, 11, lambda i, j: (j - 5, i - 5, 1), {(i, j) for i in range(4, 7) for j in range(4, 7)})
    assert (row["n_holes"], row["n_inconsistent"], row["max_residual"], row["n_components"]) == (1, 1, 1, 1)
    beside = gate(spark, 11, 11, lambda i, j: (j + 20, i - 5, 1), {(i, j) for i in range(4, 7) for j in range(4, 7)})
    assert (beside["n_holes"], beside["n_inconsistent"], beside["max_residual"]) == (1, 0, 0)
    # the hole's lower left corner: the diagonal there has no quad at its middle
    assert row["invalid_midpoints"] == beside["invalid_midpoints"] > 0
    assert gate(spark, 7, 9, lambda i, j: (j + 20, i - 3, 1))["n_inconsistent"] == 0


def test_gate_on_ragged_patches_matches_potentials(spark):
    rng = np.random.default_rng(11)
    for k in range(3):
        skip = {(i, j) for i in range(9) for j in range(10) if rng.random() < 0.12}
        turn = rng.uniform(-4, 4, 2)
        at = lambda i, j: (j - 5 + turn[0] + 0.013, i - 4 + turn[1] + 0.017, 0)  # noqa: B023, E731
        valid = {(i, j) for i in range(8) for j in range(9) if not {(i + a, j + b) for a in (0, 1) for b in (0, 1)} & skip}
        if not valid:
            continue
        angle = lambda fi, fj: np.arctan2(at(fi, fj)[1], at(fi, fj)[0]) % (2 * np.pi)  # noqa: E731, B023
        cut = lambda a, b: int(b - a < -np.pi) - int(b - a > np.pi)

        def delta(p, q):
            ends = [angle(p[0] + 0.5, p[1] + 0.5), angle(q[0] + 0.5, q[1] + 0.5)]  # noqa: B023
            m = (max(p[0], q[0]), max(p[1], q[1]))
            if p[0] != q[0] and p[1] != q[1] and m in valid:  # noqa: B023
                return cut(ends[0], angle(*m)) + cut(angle(*m), ends[1])  # noqa: B023
            return cut(*ends)  # noqa: B023

        pot, parts, bad = {}, 0, 0
        near = lambda p: [q for q in ((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in valid and q != p]  # noqa: E731, B023
        for root in sorted(valid):
            if root in pot:
                continue
            parts, pot[root], queue = parts + 1, 0, [root]
            for p in queue:
                for q in near(p):
                    if q not in pot:
                        pot[q] = pot[p] + delta(p, q)
                        queue.append(q)
        pairs = [(p, q) for p in valid for q in near(p) if p < q]
        bad = sum(pot[q] - pot[p] != delta(p, q) for p, q in pairs)
        row = gate(spark, 9, 10, at, skip)
        assert (row["n_quads"], row["n_components"], row["n_edges"]) == (len(valid), parts, len(pairs))
        assert (row["n_inconsistent"] > 0) == (bad > 0), k


def test_strips_are_sampled_from_place_to_place(spark):
    turn = np.linspace(-0.5, 0.5, 20)
    q = patches.quads(grid(spark, 5, 20, lambda i, j: ((10 + i) * np.cos(turn[j]), (10 + i) * np.sin(turn[j]), 1)))
    ask = spark.createDataFrame([(1, "p", 1.2, 1.2, 2.2, 17.2), (2, "p", 2.2, 17.2, 1.2, 1.2), (3, "p", 1.2, 1.2, 1.2, 1.4), (4, "p", -3.0, 2.0, 2.0, 2.0), (5, "none", 1.0, 1.0, 2.0, 2.0)], "request long, patch_id string, from_i double, from_j double, to_i double, to_j double")
    got = {r["request"]: r for r in patches.strip_deltas(ask, q, axis_table(spark, AXIS)).collect()}
    assert {k: r["delta"] for k, r in got.items()} == {1: 1, 2: -1, 3: 0, 4: 0, 5: None}
    assert got[3]["n_quads"] == 1 and got[3]["n_valid"] == 3 and got[4]["n_dropped"] > 0 and got[1]["n_dropped"] == 0


def test_projection_onto_a_plane(spark):
    c = grid(spark, 6, 6, lambda i, j: (i, j, 0))
    rng = np.random.default_rng(4)
    p = [(k, *map(float, rng.uniform((0, 0, -2), (5, 5, 2)))) for k in range(40)] + [(99, 2.0, 2.0, 9.0), (98, -1.0, 2.0, 0.0)]
    hits = patches.project(spark.createDataFrame(p, "pid long, x double, y double, z double"), patches.triangles(patches.quads(c)))
    got = {r["pid"]: r["distance"] for r in hits.collect()}
    want = {k: abs(z) for k, x, y, z in p if k < 90} | {98: 1.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_projection_onto_triangles_of_many_sizes(spark):
    rng = np.random.default_rng(21)
    rows = []
    for k, size in enumerate([0.01, 0.4, 3.0, 50.0, 900.0] * 4):
        a = rng.uniform(-20, 20, 3)
        rows.append((f"p{k % 3}", k, 0, 0, *[tuple(map(float, c)) for c in (a, a + rng.normal(size=3) * size, a + rng.normal(size=3) * size)]))
    c = "struct<x:double,y:double,z:double>"
    tri = spark.createDataFrame(rows, f"patch_id string, i long, j long, side int, a {c}, b {c}, c {c}")
    places = [(k, *map(float, rng.uniform(-22, 22, 3))) for k in range(150)]
    pts = spark.createDataFrame(places, "pid long, x double, y double, z double")
    each = spark.createDataFrame([(p[0], *r[:4], p[1:], *r[4:]) for p in places for r in rows], f"pid long, patch_id string, i long, j long, side int, p {c}, a {c}, b {c}, c {c}")
    want = {}
    for r in patches.with_triangle_distance(each).collect():
        if r["distance"] <= 2.5:
            key = r["pid"], r["patch_id"]
            want[key] = min(want.get(key, (9e9, 0)), (r["distance"], r["i"]))
    got = {(r["pid"], r["patch_id"]): (r["distance"], r["i"]) for r in patches.project(pts, tri).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_lift_and_erosion(spark):
    c = grid(spark, 5, 5, lambda i, j: (2 * i, 3 * j, i + j), {(4, 4)})
    at = spark.createDataFrame([("p", 1.5, 2.25), ("p", 3.5, 3.5)], "patch_id string, fi double, fj double")
    rows = {r["fi"]: r for r in patches.lift(at, patches.quads(c)).collect()}
    assert (rows[1.5]["x"], rows[1.5]["y"], rows[1.5]["z"], rows[1.5]["valid"]) == (3.0, 6.75, 3.75, True)
    assert not rows[3.5]["valid"] and rows[3.5]["x"] == -1.0
    assert patches.erode(c).count() == 9 and patches.erode(c, 2).count() == 1


def test_names_with_the_separator_inside(spark):
    names = spark.createDataFrame([("between_patches__a__b__c",), ("between_patches__a__x",), ("other__a__c",)], "name string")
    known = spark.createDataFrame([("a",), ("b__c",), ("c",)], "patch_id string")
    assert [tuple(r) for r in patch_graph.named_pairs(names, known).collect()] == [("between_patches__a__b__c", "a", "b__c")]


def test_reach_and_loops(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 3)], "from_patch string, to_patch string, delta long")
    r = patch_graph.reach(e, spark.createDataFrame([("a",)], "patch_id string"))
    assert {x["patch_id"]: (x["hops"], x["winding"]) for x in r.collect()} == {"a": (0, 0), "b": (1, 1), "c": (1, 3)}
    assert [x["holonomy"] for x in patch_graph.loop_holonomies(r, e).collect()] == [1]


def test_reach_has_no_end_and_roots_every_component(spark, monkeypatch):
    rows = [(f"a{k:02}", f"a{k + 1:02}", 1) for k in range(70)] + [("b", "c", 2)]
    e = spark.createDataFrame(rows, "from_patch string, to_patch string, delta long")
    held = spark.createDataFrame([(p,) for p in {x for r in rows for x in r[:2]} | {"alone"}], "patch_id string").withColumn("kind", F.lit("absolute")).withColumn("wind_a", F.lit(5.0))
    monkeypatch.setattr(patch_queries, "relative_edges", lambda spark, sf_dir: e)
    monkeypatch.setattr(patch_queries, "attached", lambda spark, sf_dir: held)
    got = {r["patch_id"]: (r["root"], r["hops"], r["winding"]) for r in patch_queries.patch_reach(spark, "").collect()}
    assert got == {f"a{k:02}": ("a00", k, k) for k in range(71)} | {"b": ("b", 0, 0), "c": ("b", 1, 2), "alone": ("alone", 0, 0)}
    few = patch_graph.reach(e, held.where("patch_id = 'a00'"), max_hops=2)
    assert few.count() == 3


def test_subgraphs_of_all_traces(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", 7), ("c", "d", 40), ("d", "e", 41)], "from_patch string, to_patch string, cid long")
    held = spark.createDataFrame([(p,) for p in "aabcddef"], "patch_id string")
    monkeypatch.setattr(patch_queries, "relative_edges", lambda spark, sf_dir: e)
    monkeypatch.setattr(patch_queries, "attached", lambda spark, sf_dir: held)
    got = {(r["component"], r["n_patches"], r["total_area"], r["top_patches"], r["place"]) for r in patch_queries.disconnected_subgraphs(spark, "").collect()}
    assert got == {("c", 3, 4.0, "d,c,e", 1), ("a", 2, 3.0, "a,b", 2), ("f", 1, 1.0, "f", 3)}


def test_strips_to_all_quads(spark, monkeypatch):
    c = grid(spark, 6, 16, lambda i, j: (10 + i, j + 2.5, 0), {(5, 14)}).withColumn("patch_id", F.lit("p3"))
    monkeypatch.setattr(patch_queries, "cells", lambda spark, sf_dir: c)
    asked = {3 * 600 + r["i"] * 30 + r["j"]: int(r["j"] + 3 >= 15) - 1 for r in patches.quads(c).collect()}
    got = {r["request"]: r["delta"] for r in patch_queries.strip_deltas(spark, "").collect()}
    assert len(asked) == 5 * 15 - 2 and got == asked


def document(points, version="1", metadata=None):
    return json.dumps({"vc_pointcollections_json_version": version, "collections": {"7": {"name": "n", "metadata": metadata or {}, "color": [1, 0, 0], "points": points}}})


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(document({"1": {"p": [1, 2, 3], "wind_a": 2, "creation_time": 5}, "2": {"p": [4, 5, 6]}}, metadata={"winding_is_absolute": True}))
    rows = docs.read_collections(spark, str(tmp_path)).orderBy("pid").collect()
    assert [(r["cid"], r["pid"], r["x"], r["wind_a"], r["is_absolute"]) for r in rows] == [(7, 1, 1.0, 2.0, True), (7, 2, 4.0, None, True)]
    digest = docs.file_digests(spark, str(tmp_path)).first()
    assert len(digest["sha256"]) == 64
    state = docs.verify_manifest(docs.file_digests(spark, str(tmp_path)), spark.createDataFrame([("a.json", "x"), ("b.json", "y")], "name string, sha256 string"))
    assert {r["name"]: r["state"] for r in state.collect()} == {"a.json": "changed", "b.json": "missing"}


@pytest.mark.parametrize("bad", [document({"1": {"p": [1, 2, 3]}}, version="2"), document({"1": {"p": [1, 2]}}), document({"1": {"p": [1, 2, 3, 4]}})])
def test_bad_documents(spark, bad):
    frame = spark.createDataFrame([("s", bad)], "source string, value string")
    with pytest.raises(Exception, match="version|invalid point"):
        docs.flatten(frame).collect()
    assert docs.flatten(frame, strict=False).count() == 0


def test_ids_equal_as_numbers(spark):
    twice = document({"1": {"p": [1, 2, 3]}, "01": {"p": [1, 2, 4]}})
    frame = spark.createDataFrame([("s", twice)], "source string, value string")
    assert docs.duplicate_ids(docs.flatten(frame, strict=False)).count() == 1
    with pytest.raises(Exception, match="duplicate point id"):
        docs.flatten(frame).collect()
    both = json.dumps({"vc_pointcollections_json_version": "1", "collections": {"1": {"points": {}}, "01": {"points": {}}}})
    with pytest.raises(Exception, match="duplicate collection id"):
        docs.flatten(spark.createDataFrame([("s", both)], "source string, value string")).collect()
    fine = document({"1": {"p": [1, 2, 3]}, "10": {"p": [1, 2, 4]}, "100": {"p": [1, 2, 5]}})
    assert docs.flatten(spark.createDataFrame([("s", fine)], "source string, value string")).count() == 3


def test_relative_edges_count_crossings_between(spark):
    rows = [(1, 1, 6.2, 1.0, "a"), (1, 2, 0.1, 2.0, None), (1, 3, 0.2, 3.0, "b")]
    e = patch_graph.relative_edges(spark.createDataFrame(rows, "cid long, pid long, theta double, wind_a double, patch_id string"))
    assert [(r["from_patch"], r["to_patch"], r["delta"]) for r in e.collect()] == [("a", "b", 1)]
    assert e.select(F.max("pid_to")).first()[0] == 3


def test_loops_step_by_step(spark):
    rows = [("a", "b", 1, 1, 10, 11), ("b", "c", 1, 1, 12, 13), ("a", "d", 0, 2, 20, 21), ("d", "e", 2, 2, 22, 23), ("c", "e", 5, 3, 30, 31), ("b", "d", -1, 4, 40, 41), ("a", "b", 1, 9, 90, 91)]
    e = spark.createDataFrame(rows, "from_patch string, to_patch string, delta long, cid long, pid_from long, pid_to long")
    reached = patch_graph.reach(e, spark.createDataFrame([("a",)], "patch_id string"))
    loops = {}
    for r in patch_graph.loop_cycles(reached, e).collect():
        loops.setdefault((r["from_patch"], r["to_patch"], r["loop_delta"], r["residual"]), []).append(r)
    # b - d closes, c - e doesn't: e is reached at 2 by d, by c it would be 7
    assert loops.keys() == {("c", "e", 5, -5)}
    steps = sorted(loops["c", "e", 5, -5], key=lambda r: r["seq"])
    assert [(r["patch_id"], r["next_patch"], r["delta"], r["kind"]) for r in steps] == [("c", "b", -1, "tree"), ("b", "a", -1, "tree"), ("a", "d", 0, "tree"), ("d", "e", 2, "tree"), ("e", "c", -5, "closing")]
    assert [(r["cid"], r["pid_from"], r["pid_to"]) for r in steps] == [(1, 13, 12), (1, 11, 10), (2, 20, 21), (2, 22, 23), (3, 31, 30)]
    assert [r["pid_in"] for r in steps] == [30, 12, 10, 21, 23] and {r["lca"] for r in steps} == {"a"}
    assert sum(r["delta"] for r in steps) == -5


def test_gate_of_short_traces(spark):
    p = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 3, True), (2, 4, False), (2, 5, True), (2, 6, True), (3, 7, False), (4, 8, None), (4, 9, True)], "cid long, pid long, hit boolean")
    got = {r["pid"] for r in patch_graph.hit_gate(p).where("gated").collect()}
    # of two points both have to hit, of three all; a point that doesn't hit never passes
    assert got == {1, 2, 5}


def plain_links(points, hits, areas, pairs, policy, window, least):
    """points: pid -> (cid, name, patch)."""
    chains, out = {}, {}
    for pid in sorted(points):
        chains.setdefault(points[pid][0], []).append(pid)
    fair = {}
    for pid, patch, d in hits:
        pair = pairs.get(points[pid][1])
        if pair is None or patch in pair:
            fair.setdefault(patch, {})[pid] = d
    for patch, own in fair.items():
        for pid, d in own.items():
            chain = chains[points[pid][0]]
            k = chain.index(pid)
            near = chain[max(0, k - window // 2) : k + window // 2 + 1]
            if sum(q in own for q in near) >= min(least, len(near)) and points[pid][2] is None:
                area = 0 if pairs.get(points[pid][1]) or policy == "nearest" else -areas.get(patch, 0)
                out[pid] = min(out.get(pid, (1e9, 1e9, "~")), (area, d, patch))
    return {pid: (patch, d) for pid, (_, d, patch) in out.items()}


@pytest.mark.parametrize("policy", ["nearest", "largest_area"])
def test_links_of_policies_windows_and_pairs(spark, policy):
    rng = np.random.default_rng(3)
    points = {pid: (pid // 7, ["t", "t", "between_patches__a__b"][pid // 7 % 3], [None, None, "a"][int(rng.integers(3)) if pid % 4 == 0 else 0]) for pid in range(60)}
    hits = [(pid, p, float(rng.integers(1, 4))) for pid in points for p in "abcde" if rng.random() < 0.6]
    areas, pairs = {"a": 5.0, "b": 5.0, "c": 9.0, "d": 1.0}, {"between_patches__a__b": ("a", "b")}
    pf = spark.createDataFrame([(c, pid, n, p) for pid, (c, n, p) in points.items()], "cid long, pid long, name string, patch_id string")
    hf = spark.createDataFrame(hits, "pid long, patch_id string, distance double")
    af, nf = spark.createDataFrame(list(areas.items()), "patch_id string, area double"), spark.createDataFrame([(k, *v) for k, v in pairs.items()], "name string, first string, second string")
    got = {r["pid"]: (r["patch_id"], r["distance"]) for r in linking.chosen_links(pf, hf, af, nf, policy, 5, 3).collect()}
    assert got == plain_links(points, hits, areas, pairs, policy, 5, 3) and got
    with pytest.raises(ValueError):
        linking.chosen_links(pf, hf, af, policy="largest")


def test_new_patches_link_as_if_all_were_linked_again(spark):
    rng = np.random.default_rng(12)
    points = [(pid // 9, pid, False, 1.0, "t", None) for pid in range(72)]
    pf = spark.createDataFrame(points, "cid long, pid long, absolute boolean, wind_a double, name string, patch_id string")
    hits = spark.createDataFrame([(pid, p, float(rng.random())) for pid in range(72) for p in "abcd" if rng.random() < 0.45], "pid long, patch_id string, distance double")
    areas = hits.select("patch_id").distinct().withColumn("area", F.lit(1.0))
    first = linking.linked_points(pf, linking.chosen_links(pf, hits.where("patch_id in ('a', 'b')"), areas, None, "nearest", 5, 3))
    links = linking.link_new_patches(first, hits.where("patch_id in ('c', 'd')"), areas, None, "nearest", 5, 3)
    after = {r["pid"]: r["patch_id"] for r in linking.linked_points(first, links).collect()}
    before = {r["pid"]: r["patch_id"] for r in first.collect()}
    again = {r["pid"]: r["patch_id"] for r in linking.chosen_links(pf, hits, areas, None, "nearest", 5, 3).collect()}
    assert {k for k, v in after.items() if v} == set(again)
    assert all(after[k] == v for k, v in before.items() if v) and all(after[k] == again[k] for k in again if before[k] is None)
    won = {r["cid"]: r["gained"] for r in linking.gains(first, links).collect()}
    assert sum(won.values()) == sum(before[k] is None and after[k] is not None for k in before) > 0


def test_absolute_points_need_a_winding(spark):
    pf = spark.createDataFrame([(1, 1, True, 0.0, None), (1, 2, True, 2.0, None), (1, 3, True, None, None), (2, 4, False, None, None)], "cid long, pid long, absolute boolean, wind_a double, patch_id string")
    hits = spark.createDataFrame([(k, "n", 1.0) for k in (1, 2, 3, 4)], "pid long, patch_id string, distance double")
    areas = spark.createDataFrame([("n", 1.0)], "patch_id string, area double")
    assert {r["pid"] for r in linking.link_new_patches(pf, hits, areas).collect()} == {2, 4}


def test_sides(spark):
    rows = [(1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (3, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (4, None, 0.0, 0.0, 1.0, 0.0, 0.0), (5, 0.1, 9.0, 0.0, 1.0, 0.0, 0.0)]
    hits = spark.createDataFrame(rows, "pid long, ax double, ay double, az double, ix double, iy double, iz double")
    kept = lambda rule: {r["pid"] for r in linking.on_side(hits, rule, 0.5).collect()}
    assert kept("front") == {1, 3, 4, 5} and kept("behind") == {2, 3, 4, 5}
    with pytest.raises(ValueError):
        linking.on_side(hits, "above", 0.5)
