"""Steps whose rounds must not grow with the depth of a graph, nor rows with the length of ways."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import patch_graph, patches
from plumbline.sources.helix import axis_table


def breadth_first(rows, roots):
    """patch: (root, hops, winding, via) as reach has it."""
    around = {}
    for a, b, d in rows:
        around.setdefault(a, []).append((b, d))
        around.setdefault(b, []).append((a, -d))
    done, now, hop = {r: (r, 0, 0, None) for r in roots}, list(roots), 0
    while now:
        hop += 1
        first = {}
        for u in now:
            for v, d in around.get(u, []):
                if v not in done:
                    first.setdefault(v, []).append((u, done[u][2] + d, done[u][0]))
        now = list(first)
        done |= {v: (min(w)[2], hop, min(w)[1], min(w)[0]) for v, w in first.items()}
    return done


def test_reach_does_not_walk_a_deep_graph(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{k:03}", f"n{k + 1:03}", rng.randint(-2, 2)) for k in range(30)]
    rows += [(f"n{k:03}", f"n{k + rng.randint(1, 3):03}", rng.randint(-2, 2)) for k in range(0, 27, 4)]  # ladders and edges that disagree
    rows += [("hub", f"m{k}", k) for k in range(9)] + [(f"m{k}", f"m{k + 1}", 1) for k in range(8)] + [("hub", "n027", 4), ("x", "y", 1), ("n030", "n030", 0)]
    roots = ["n000", "n017", "y", "alone"]
    monkeypatch.setattr(patch_graph, "WALKED", 3)
    written = []
    keep = patch_graph.durable
    monkeypatch.setattr(patch_graph, "durable", lambda df, name: written.append(name) or keep(df, name))
    got = patch_graph.reach(spark.createDataFrame(rows, "from_patch string, to_patch string, delta long"), spark.createDataFrame([(r,) for r in roots], "patch_id string"))
    assert {r["patch_id"]: (r["root"], r["hops"], r["winding"], r["via"]) for r in got.collect()} == breadth_first(rows, roots)
    assert written.count("frontier") <= 3 and written.count("chosen") <= 16


def test_strips_sample_a_shared_step_once(spark, monkeypatch):
    """Two places in a patch with a hole, from each to all quads and to places off the patch."""
    turn = np.linspace(-2.5, 2.5, 40)
    cells = [("p", i, j, (10 + i) * np.cos(turn[j]), (10 + i) * np.sin(turn[j]), 1.0) for i in range(9) for j in range(40) if not (3 <= i <= 5 and 12 <= j <= 15)]
    q = patches.quads(spark.createDataFrame([(p, i, j, float(x), float(y), z) for p, i, j, x, y, z in cells], "patch_id string, i long, j long, x double, y double, z double"))
    axis = axis_table(spark, [(-10.0, 0.0, 0.0), (10.0, 0.0, 0.0)])
    places = [(i + 0.5, j + 0.5) for i in range(8) for j in range(39)] + [(-4.0, 3.2), (4.3, 14.1), (11.0, 50.0), (2.2, 17.9)]
    asked = [(2**60 + 1000 * k + n, "p", *start, *to) for k, start in enumerate([(0.2, 1.2), (4.5, 13.5)]) for n, to in enumerate(places)]
    ask = spark.createDataFrame(asked, "request long, patch_id string, from_i double, from_j double, to_i double, to_j double")
    whole = patches.path_transport(patches.strip_samples(ask, q), axis)
    want = {r["line_id"]: (r["delta"], r["n_valid"], r["n_dropped"]) for r in whole.collect()}
    sizes = {r["request"]: r["n_quads"] for r in patches.routes(ask, q).groupBy("request").agg(F.max("n_quads").alias("n_quads")).collect()}
    lifted, lift = [], patches.lift
    monkeypatch.setattr(patches, "lift", lambda p, quads: lifted.append(p) or lift(p, quads))
    got = patches.strip_deltas(ask, q, axis).collect()
    assert {r["request"]: (r["delta"], r["n_valid"], r["n_dropped"]) for r in got} == want and {r["request"]: r["n_quads"] for r in got} == sizes
    assert len({d for d, _, _ in want.values()}) > 1 and any(n for _, _, n in want.values())
    assert sum(p.count() for p in lifted) <= 3 * len(asked)
