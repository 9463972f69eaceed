import random

import pytest

from plumbline.operators import graph, measured, patches
from plumbline.sources.helix import axis_table

AXIS = [(-1000.0, 0.0, 0.0), (20000.0, 0.0, 0.0)]
EDGES = "from_patch string, to_patch string, cid long, pid_from long, pid_to long, delta long, from_i double, from_j double, to_i double, to_j double, fx double, fy double, fz double, tx double, ty double, tz double"


def two_patches(spark, skip=()):
    """Patches p and q beside each other; the cut (y = 0) runs between their rows 4 and 5."""
    rows = [(n, i, j, 10.0 + j + shift, i - 4.5, 0.0) for n, shift in (("p", 0), ("q", 20)) for i in range(9) for j in range(6) if (n, i, j) not in skip]
    return patches.quads(spark.createDataFrame(rows, "patch_id string, i long, j long, x double, y double, z double"))


def entries(spark):
    return spark.createDataFrame([("p", 1.5, 2.5), ("q", 6.5, 2.5)], "patch_id string, i double, j double")


def run(spark, rows, quads, **more):
    edges = spark.createDataFrame(rows, EDGES)
    return {r["cid"]: r for r in measured.measured_edges(edges, entries(spark), quads, axis_table(spark, AXIS), **more).collect()}


def test_strips_and_gaps_add_up(spark):
    rows = [
        ("p", "q", 1, 10, 11, 3, 7.2, 1.0, 7.0, 3.0, 11.0, 2.8, 0.0, 33.0, 2.6, 0.0),  # up from the entry of p, at the height of q's
        ("p", "q", 2, 20, 21, 3, 4.4, 1.0, 7.0, 3.0, 11.0, 0.3, 0.0, 33.0, 2.6, 0.0),  # attached below the cut, its point above
        ("p", "q", 3, 30, 31, 3, 1.0, 1.0, 4.6, 3.0, 11.0, -3.5, 0.0, 33.0, -0.2, 0.0),  # comes in above the cut, its point below
    ]
    got = run(spark, rows, two_patches(spark))
    assert {k: (r["strip_from"], r["strip_to"], r["gap_from"], r["gap_to"], r["measured"]) for k, r in got.items()} == {1: (1, 0, 0, 0, 4), 2: (0, 0, 1, 0, 4), 3: (0, 0, 0, 1, 4)}
    bare = run(spark, rows, two_patches(spark), gaps=False)
    assert {k: r["measured"] for k, r in bare.items()} == {1: 4, 2: 3, 3: 3}


def test_what_cannot_be_measured(spark):
    wall = {("p", 4, j) for j in range(6)}
    row = ("p", "q", 1, 10, 11, 3, 7.2, 1.0, 7.0, 3.0, 11.0, 2.8, 0.0, 33.0, 2.6, 0.0)
    far = ("p", "none", 2, 10, 11, 3, 1.2, 1.0, 7.0, 3.0, 11.0, 2.8, 0.0, 33.0, 2.6, 0.0)
    got = run(spark, [row, far], two_patches(spark, wall))
    assert {k: (r["strip_from"], r["gap_from"], r["measured"]) for k, r in got.items()} == {1: (None, 0, None), 2: (0, 0, None)}


def test_shifts_reach_what_lies_behind(spark):
    rng = random.Random(4)
    parent = {f"n{k:02}": None if k == 0 else f"n{rng.randint(max(0, k - 3), k - 1):02}" for k in range(40)}
    winding = {n: rng.randint(-5, 5) for n in parent}
    change = {n: rng.randint(-2, 2) for n in rng.sample(sorted(parent)[1:], 9)}
    reached = spark.createDataFrame([(n, "n00", winding[n], v) for n, v in parent.items()], "patch_id string, root string, winding long, via string")
    got = {r["patch_id"]: r["winding"] for r in measured.shifted_windings(reached, spark.createDataFrame(list(change.items()), "patch_id string, change long")).collect()}
    total = lambda n: 0 if n is None else change.get(n, 0) + total(parent[n])
    assert got == {n: winding[n] + total(n) for n in parent}
    same = measured.shifted_windings(reached, spark.createDataFrame([], "patch_id string, change long")).collect()
    assert {r["patch_id"]: r["winding"] for r in same} == winding


def test_margins_one_by_one(spark):
    rng = random.Random(8)
    side = "struct<node:string,pid:long>"
    rows = [((f"n{a}", k), (f"n{b}", 100 + k), rng.uniform(-70, 70), rng.randint(-1, 1)) for k in range(300) for a, b in [sorted(rng.sample(range(5), 2))]]
    pairs = spark.createDataFrame(rows, f"a {side}, b {side}, gap double, offset long")
    links = [(f"n{a}", f"n{b}", rng.randint(0, 1)) for _ in range(40) for a, b in [sorted(rng.sample(range(3, 9), 2))]]
    found = spark.createDataFrame([(a, b, a, b, o, k, k) for k, (a, b, o) in enumerate(links)], "a string, b string, akey string, bkey string, offset long, pid_a long, pid_b long")
    grid = [3.0, 0.5, 1.0, 2.0]
    got = {r["margin"]: r for r in graph.margin_grid(pairs, found, 20.0, grid, 2).collect()}
    assert sorted(got) == sorted(grid)
    for m in grid:
        arcs = graph.order_arcs(pairs, found, 20.0, m, 2).collect()
        assert got[m]["n_arcs"] == len(arcs) and got[m]["n_groups"] == len({r["grp"] for r in arcs})
        assert got[m]["n_nodes"] == len({x for r in arcs for x in (r["u"], r["v"])})
        assert got[m]["n_point_pairs"] == sum({r["grp"]: r["n_links"] for r in arcs}.values())
        assert got[m]["n_conflicts"] == graph.conflict_endpoints(spark.createDataFrame(arcs)).count()
    with pytest.raises(ValueError):
        graph.margin_grid(pairs, found, 20.0, [0.0, 1.0], 2)
    nothing = graph.margin_grid(pairs.limit(0), found.limit(0), 20.0, [1.0], 2).first()
    assert tuple(nothing) == (1.0, 0, 0, 0, 0, 0)


def test_scans_of_the_edges_query(spark, sf_dir):
    """Points are read for the nodes alone; what follows reads written tables."""
    from plumbline.plans import audit_queries

    plan = audit_queries.edges(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and plan.count("Scan parquet") + plan.count("FileScan") <= 8
    assert audit_queries.nodes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
