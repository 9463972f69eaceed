"""The graph between patches: relative edges from traces that pass from one to another,
what can be reached from a root, votes of absolute anchors, and what is cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import cut_crossing
from plumbline.operators.components import connected_components, discard, durable
from plumbline.operators.forest import common_ancestors, lifts, ways
from plumbline.operators.ranking import placed

#: Rounds of reach that go level by level, and neighbours of a patch that hops_from takes out.
WALKED = 32
FEW = 4


def hit_gate(points: DataFrame, window: int = 5, least: int = 3) -> DataFrame:
    """points (cid, pid, hit) with gated: whether a point hits the patch, and so do `least` of
    those around it, itself included. The window is clipped at a trace's ends; of a window with
    fewer points all have to hit."""
    half = window // 2
    w = Window.partitionBy("cid").orderBy("pid").rowsBetween(-half, half)
    enough = F.count_if("hit").over(w) >= F.least(F.lit(least), F.count(F.lit(1)).over(w))
    return points.withColumn("gated", F.coalesce(F.col("hit"), F.lit(False)) & enough)


def relative_edges(attached: DataFrame, sense: int = 1) -> DataFrame:
    """Edges between patches: successive attached points of one trace on different patches give
    from_patch, to_patch, cid, pid_from, pid_to, delta (annotated difference less the cut's
    crossings on the way). attached: cid, pid, theta, wind_a, patch_id (null: no patch)."""
    chain = Window.partitionBy("cid").orderBy("pid")
    p = attached.withColumn("_b", F.lag("theta").over(chain))
    p = p.withColumn("_cuts", F.sum(F.when(F.col("_b").isNull(), 0).otherwise(cut_crossing(F.col("_b"), F.col("theta")))).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.where("patch_id is not null")
    for c in ("patch_id", "pid", "wind_a", "_cuts"):
        p = p.withColumn("n_" + c, F.lead(c).over(chain))
    delta = F.coalesce(F.col("n_wind_a") - F.col("wind_a"), F.lit(0.0)).cast("long") - F.lit(sense) * (F.col("n__cuts") - F.col("_cuts"))
    p = p.where(F.col("n_patch_id") != F.col("patch_id"))
    return p.select(F.col("patch_id").alias("from_patch"), F.col("n_patch_id").alias("to_patch"), "cid", F.col("pid").alias("pid_from"), F.col("n_pid").alias("pid_to"), delta.alias("delta"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("to_patch").alias("from_patch"), F.col("from_patch").alias("to_patch"), (-F.col("delta")).alias("delta"))
    return edges.select("from_patch", "to_patch", "delta").unionAll(back).distinct()


def component_roots(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_id: the least patch of each component of the graph; patches without edges are
    components of their own."""
    nodes = patches.select(F.col("patch_id").alias("node")).distinct().withColumn("label", F.col("node"))
    found = connected_components(nodes, edges.select(F.col("from_patch").alias("a"), F.col("to_patch").alias("b")))
    return found.select(F.col("label").alias("patch_id")).distinct()


def hops_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """patch_id, hops (durable): the fewest edges (from_patch, to_patch; both ways) from a root to
    each patch that one reaches.

    Rounds take out patches with few neighbours, no two of them neighbours, and join what lay
    around each by longer edges, so a path of n patches is gone after about log n rounds.
    What is left (patches of many neighbours) is walked edge by edge; then the patches come
    back in reverse, each from those that lay around it."""
    now = durable(edges.where("from_patch <> to_patch").select(F.col("from_patch").alias("u"), F.col("to_patch").alias("v")).distinct().withColumn("w", F.lit(1).cast("long")), "around")
    seeds = durable(roots.select(F.col("patch_id").alias("u"), F.lit(0).cast("long").alias("hops")).distinct(), "seeds")
    out: list[tuple[DataFrame, DataFrame]] = []
    while True:
        few = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FEW).select("u", F.struct(F.xxhash64("u", F.lit(len(out))).alias("h"), "u").alias("at"))
        few = durable(few, "few")
        beside = now.join(few.select(F.col("u").alias("v"), F.col("at").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        chosen = durable(few.join(beside, "u", "left").where("other IS NULL OR at < other").select("u"), "chosen")
        discard(few)
        if chosen.isEmpty():
            discard(chosen)
            break
        taken = durable(now.join(chosen, "u", "left_semi"), "taken")
        one, two = taken.select("u", F.col("v").alias("a"), F.col("w").alias("wa")), taken.select("u", F.col("v").alias("b"), F.col("w").alias("wb"))
        longer = one.join(two, "u").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("wa") + F.col("wb")).alias("w"))
        left = now.join(chosen, "u", "left_anti").join(chosen.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v", "w")
        told = taken.join(seeds, "u").select(F.col("v").alias("u"), (F.col("hops") + F.col("w")).alias("hops"))
        out.append((taken, seeds))
        before, now = now, durable(left.unionAll(longer).groupBy("u", "v").agg(F.min("w").alias("w")), "around")
        seeds = durable(seeds.unionAll(told).groupBy("u").agg(F.min("hops").alias("hops")), "seeds")
        for written in (before, chosen):
            discard(written)
    found = durable(seeds.withColumn("fresh", F.lit(True)), "hops")
    while not found.where("fresh").isEmpty():
        told = found.where("fresh").join(now, "u").select(F.col("v").alias("u"), (F.col("hops") + F.col("w")).alias("hops"), F.lit(None).cast("long").alias("was"))
        every = told.unionAll(found.select("u", "hops", F.col("hops").alias("was"))).groupBy("u").agg(F.min("hops").alias("hops"), F.min("was").alias("was"))
        before, found = found, durable(every.select("u", "hops", F.coalesce(F.col("hops") < F.col("was"), F.lit(True)).alias("fresh")), "hops")
        discard(before)
    discard(now)
    found = found.select("u", "hops")
    for k, (taken, own) in enumerate(reversed(out)):
        # hops of those around a patch are known by now; its own may come from a root of its own
        back = taken.join(found.select(F.col("u").alias("v"), "hops"), "v").select("u", (F.col("hops") + F.col("w")).alias("hops"))
        found = found.unionAll(back.unionAll(own.join(taken.select("u").distinct(), "u", "left_semi")).groupBy("u").agg(F.min("hops").alias("hops")))
        found = durable(found.groupBy("u").agg(F.min("hops").alias("hops")), "hops")
    for pair in out:
        for written in pair:
            discard(written)
    return found.select(F.col("u").alias("patch_id"), F.col("hops").cast("int").alias("hops"))


def rooted(parents: DataFrame) -> DataFrame:
    """patch_id, root, winding of patches with via (null at roots) and delta from it, added up by
    doubling strides towards the roots."""
    now = durable(parents.select("patch_id", F.col("via").alias("up"), F.coalesce("via", "patch_id").alias("root"), F.coalesce("delta", F.lit(0)).cast("long").alias("winding")), "strides")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("patch_id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("top"), F.col("winding").alias("more"))
        new = now.join(above, "up", "left").select("patch_id", F.col("up2").alias("up"), F.coalesce("top", "root").alias("root"), (F.col("winding") + F.coalesce("more", F.lit(0))).alias("winding"))
        before, now = now, durable(new, "strides")
        discard(before)
    return now.drop("up")


def reach(edges: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """patch_id, root, hops, winding, via: breadth-first from the roots (patch_id), to every
    patch they reach unless max_hops says less. Of several first arrivals the one from the
    least patch with the least winding counts. After WALKED rounds hops are looked up by
    hops_from, for rounds would be as many as the graph is deep."""
    e = durable(both_ways(edges), "patch-edges")
    done = durable(roots.select("patch_id", F.col("patch_id").alias("root"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("winding"), F.lit(None).cast("string").alias("via")), "reached")
    frontier, hop = done, 0
    while max_hops is None or hop < max_hops:
        if hop == WALKED:
            return _deep_reach(e, roots, max_hops)
        hop += 1
        step = frontier.join(e, frontier["patch_id"] == e["from_patch"]).groupBy("to_patch").agg(F.min(F.struct(F.col("from_patch").alias("via"), (F.col("winding") + F.col("delta")).alias("winding"), "root")).alias("m"))
        new = step.select(F.col("to_patch").alias("patch_id"), "m.root", F.lit(hop).alias("hops"), "m.winding", "m.via").join(done.select("patch_id"), "patch_id", "left_anti")
        frontier = durable(new, "frontier")
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
    return done


def _deep_reach(e: DataFrame, roots: DataFrame, max_hops: int | None) -> DataFrame:
    hops = hops_from(e, roots)
    near = durable(hops if max_hops is None else hops.where(F.col("hops") <= max_hops), "hops")
    side = lambda s: near.select(F.col("patch_id").alias(s), F.col("hops").alias("hops_" + s))
    first = e.join(side("from_patch"), "from_patch").join(side("to_patch"), "to_patch").where("hops_to_patch = hops_from_patch + 1")
    first = first.groupBy(F.col("to_patch").alias("patch_id")).agg(F.min(F.struct(F.col("from_patch").alias("via"), "delta")).alias("m"))
    parents = durable(near.join(first, "patch_id", "left").select("patch_id", "hops", "m.via", "m.delta"), "parents")
    return parents.join(rooted(parents), "patch_id").select("patch_id", "root", "hops", "winding", "via")


def loop_holonomies(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """from_patch, to_patch, holonomy of the edges that close a loop (each once)."""
    e = both_ways(edges).where("from_patch < to_patch")
    side = lambda s: reached.select(F.col("patch_id").alias(s), F.col("winding").alias("w_" + s), F.col("via").alias("via_" + s))
    j = e.join(side("from_patch"), "from_patch").join(side("to_patch"), "to_patch")
    tree = F.coalesce(F.col("via_to_patch") == F.col("from_patch"), F.lit(False)) | F.coalesce(F.col("via_from_patch") == F.col("to_patch"), F.lit(False))
    h = F.col("w_to_patch") - F.col("w_from_patch") - F.col("delta")
    return j.where(~(tree & (h == 0))).select("from_patch", "to_patch", h.alias("holonomy"))


def witnessed(edges: DataFrame) -> DataFrame:
    """from_patch, to_patch, delta, cid, pid_from, pid_to: edges both ways, with the first trace and
    points that say so."""
    back = edges.select(F.col("to_patch").alias("from_patch"), F.col("from_patch").alias("to_patch"), (-F.col("delta")).alias("delta"), "cid", F.col("pid_to").alias("pid_from"), F.col("pid_from").alias("pid_to"))
    every = edges.select(*back.columns).unionAll(back)
    return every.groupBy("from_patch", "to_patch", "delta").agg(F.min(F.struct("cid", "pid_from", "pid_to")).alias("m")).select("from_patch", "to_patch", "delta", "m.*")


def loop_cycles(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Each loop that doesn't close, step by step: from_patch, to_patch, loop_delta (the edge that
    closes it), residual, lca, seq, patch_id, next_patch, delta, kind, cid, pid_from, pid_to,
    pid_in.

    The steps go from from_patch up to the patches' last common ancestor and down to to_patch,
    then back by the closing edge; their deltas add up to the residual. Each names the trace
    and points that it rests on; pid_in is where the step before comes into the patch, so
    pid_in and pid_from are the ends of the strip across it."""
    e = durable(witnessed(edges), "witnessed")
    bad = durable(loop_holonomies(reached, edges).where("holonomy <> 0"), "loops")
    forest = durable(reached.select(F.col("patch_id").alias("node"), F.col("via").alias("parent"), F.col("hops").cast("long").alias("depth"), "winding"), "tree")
    side = lambda s: forest.select(F.col("node").alias(s), F.col("winding").alias("w_" + s))
    loops = bad.join(side("from_patch"), "from_patch").join(side("to_patch"), "to_patch")
    loops = loops.select("from_patch", "to_patch", (F.col("w_to_patch") - F.col("w_from_patch") - F.col("holonomy")).alias("loop_delta"), F.col("holonomy").alias("residual"))
    up = lifts(forest)
    key = ["from_patch", "to_patch", "loop_delta", "residual"]
    met = durable(common_ancestors(loops.withColumn("a", F.col("from_patch")).withColumn("b", F.col("to_patch")), forest, up), "met")
    way = durable(ways(met, up).join(forest.select("node", "winding"), "node").select(*key, "lca", "seq", F.col("node").alias("patch_id"), "winding"), "ways")
    after = way.select(*key, (F.col("seq") - 1).alias("seq"), F.col("patch_id").alias("next_patch"), F.col("winding").alias("w_next"))
    tree = way.join(after, [*key, "seq"]).select(*key, "lca", "seq", "patch_id", "next_patch", (F.col("w_next") - F.col("winding")).alias("delta"), F.lit("tree").alias("kind"))
    last = (F.col("depth_a") + F.col("depth_b") - 2 * F.col("depth_lca")).alias("seq")
    closing = met.select(*key, "lca", last, F.col("to_patch").alias("patch_id"), F.col("from_patch").alias("next_patch"), (-F.col("loop_delta")).alias("delta"), F.lit("closing").alias("kind"))
    steps = tree.unionAll(closing).join(e.toDF("patch_id", "next_patch", "delta", "cid", "pid_from", "pid_to"), ["patch_id", "next_patch", "delta"])
    steps = durable(steps, "steps")
    before = steps.select(*key, F.when(F.col("kind") == "closing", F.lit(0)).otherwise(F.col("seq") + 1).cast("long").alias("seq"), F.col("pid_to").alias("pid_in"))
    found = steps.join(before, [*key, "seq"])
    return found.select(*key, "lca", "seq", "patch_id", "next_patch", "delta", "kind", "cid", "pid_from", "pid_to", "pid_in")


def anchor_votes(reached: DataFrame, anchors: DataFrame) -> DataFrame:
    """root, vote, n, agreed: what absolute anchors (patch_id, wind_a) say about their root's
    winding, and whether all say the same."""
    v = anchors.join(reached, "patch_id").groupBy("root", (F.col("wind_a").cast("long") - F.col("winding")).alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("agreed", F.count(F.lit(1)).over(Window.partitionBy("root")) == 1)


def disconnected_subgraphs(edges: DataFrame, areas: DataFrame, top: int = 5) -> DataFrame:
    """component, n_patches, total_area, place and the largest patches of each component of
    the graph; patches without edges are components of their own."""
    nodes = areas.select(F.col("patch_id").alias("node"), F.col("patch_id").alias("label"))
    e = edges.select(F.col("from_patch").alias("a"), F.col("to_patch").alias("b"))
    c = connected_components(nodes, e).join(areas.select(F.col("patch_id").alias("node"), "area"), "node")
    by_area = Window.partitionBy("label").orderBy(F.col("area").desc(), "node")
    c = c.withColumn("_i", F.row_number().over(by_area))
    g = c.groupBy(F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("n_patches"), F.sum("area").alias("total_area"), F.sort_array(F.collect_list(F.when(F.col("_i") <= top, F.struct("_i", "node")))).alias("t"))
    g = g.withColumn("top_patches", F.array_join(F.transform("t", lambda x: x["node"]), ",")).drop("t")
    return placed(g, [F.col("n_patches").desc(), F.col("total_area").desc(), F.col("component")], "place")


def named_pairs(names: DataFrame, patches: DataFrame) -> DataFrame:
    """name, first, second of targets between_patches__A__B. Ids may hold "__" themselves: the
    first split both of whose halves are patches counts."""
    mark = "between_patches__"
    n = names.where(F.col("name").startswith(mark)).withColumn("_p", F.split(F.substring("name", len(mark) + 1, 1 << 30), "__"))
    n = n.where(F.size("_p") >= 2).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
    n = n.select("name", "_k", F.array_join(F.slice("_p", 1, F.col("_k")), "__").alias("first"), F.array_join(F.expr("slice(_p, _k + 1, size(_p) - _k)"), "__").alias("second"))
    known = patches.select("patch_id").distinct()
    n = n.join(known.withColumnRenamed("patch_id", "first"), "first", "left_semi").join(known.withColumnRenamed("patch_id", "second"), "second", "left_semi")
    return n.groupBy("name").agg(F.min(F.struct("_k", "first", "second")).alias("m")).select("name", "m.first", "m.second")


def link_new(points: DataFrame, hits: DataFrame) -> DataFrame:
    """points with patch_id filled by hits (pid, patch_id) where they had none; links once made
    stay."""
    h = hits.select("pid", F.col("patch_id").alias("_new"))
    return points.join(h, "pid", "left").withColumn("patch_id", F.coalesce("patch_id", "_new")).drop("_new")
