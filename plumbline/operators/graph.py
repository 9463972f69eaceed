"""The graph of integer equations g_b - g_a = offset: components, potentials, fundamental
cycles and inequality constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import matching
from plumbline.operators.components import connected_components, discard, durable
from plumbline.operators.forest import common_ancestors, lifts, spanning_forest, ways


def graph_components(edges: DataFrame) -> DataFrame:
    """akey-style node and label (its component's least node)."""
    edges = durable(edges.select("akey", "bkey"), "edges")
    nodes = edges.select(F.col("akey").alias("node")).unionAll(edges.select("bkey")).distinct().withColumn("label", F.col("node"))
    return connected_components(nodes, edges.select(F.col("akey").alias("a"), F.col("bkey").alias("b")))


def potentials(edges: DataFrame) -> DataFrame:
    """node, root, pot: integers along edges from each component's least node. Where a component
    contradicts itself they follow some of its edges; whether it does is the same for all. Roots
    only fall and are followed once more each round, so rounds end, after about the logarithm
    of a component's length."""
    e = edges.select(F.col("akey").alias("a"), F.col("bkey").alias("b"), "offset")
    both = durable(e.unionAll(e.select("b", "a", -F.col("offset"))), "equations")
    now = durable(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("pot")), "potentials")
    while True:
        via = both.join(now.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min(F.struct("root", (F.col("pot") + F.col("offset")).alias("pot"))).alias("near"))
        hooked = now.join(via, now["node"] == via["b"], "left").select("node", F.col("root").alias("was"), F.when(F.col("near.root") < F.col("root"), F.col("near")).otherwise(F.struct("root", "pot")).alias("at"))
        hooked = durable(hooked.select("node", "was", "at.root", "at.pot"), "potentials")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("root2"), F.col("pot").alias("pot2")).where("root2 < root")
        jumped = hooked.join(up, "root", "left").select("node", "was", F.coalesce("root2", "root").alias("root"), (F.col("pot") + F.coalesce("pot2", F.lit(0))).alias("pot"))
        before, new = now, durable(jumped, "potentials")
        for written in (before, hooked):
            discard(written)
        if new.where("root <> was").isEmpty():
            discard(both)
            return new.select("node", "root", "pot")
        now = new


def component_table(edges: DataFrame) -> DataFrame:
    """Per component: root, n_nodes, n_edges, n_cycles (edges that close one), consistent."""
    edges = durable(edges.select("akey", "bkey", "offset"), "equations")
    pot = potentials(edges)
    side = lambda s: pot.select(F.col("node").alias(s + "key"), F.col("pot").alias("pot_" + s), F.col("root").alias("root_" + s))
    e = edges.join(side("a"), "akey").join(side("b"), "bkey")
    per = e.groupBy(F.col("root_a").alias("root")).agg(F.count(F.lit(1)).alias("n_edges"), F.min(F.col("pot_b") - F.col("pot_a") == F.col("offset")).alias("consistent"))
    sizes = pot.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.join(per, "root").select("root", "n_nodes", "n_edges", (F.col("n_edges") - F.col("n_nodes") + 1).alias("n_cycles"), "consistent")


def constant_nodes(points: DataFrame) -> DataFrame:
    """Nodes whose points all have one label."""
    return points.groupBy("node").agg(F.count_distinct("label").alias("n_labels")).where("n_labels <= 1").select("node")


def fundamental_cycles(edges: DataFrame, constant: DataFrame | None = None, forest: DataFrame | None = None) -> DataFrame:
    """akey, bkey, holonomy, support, path_nodes, effective and lca, depth_a, depth_b, depth_lca of
    every edge that closes a cycle with the forest's way between its ends. constant: nkey of
    nodes with one label; a cycle of those with offsets 0 can't fail and isn't effective.
    forest: spanning_forest(edges, free_nodes(edges, constant)), if it is known."""
    edges = durable(edges.select("akey", "bkey", "offset", "support"), "equations")
    forest = spanning_forest(edges, free_nodes(edges, constant)) if forest is None else forest
    side = lambda s: forest.select(F.col("node").alias(s + "key"), *[F.col(c).alias(f"{c}_{s}") for c in ("parent", "pot", "turns", "weight")])
    both = edges.join(side("a"), "akey").join(side("b"), "bkey")
    tree = F.coalesce(F.col("parent_a") == F.col("bkey"), F.lit(False)) | F.coalesce(F.col("parent_b") == F.col("akey"), F.lit(False))
    closing = both.where(~tree).withColumn("a", F.col("akey")).withColumn("b", F.col("bkey"))
    found = common_ancestors(closing, forest, lifts(forest))
    top = forest.select(F.col("node").alias("lca"), F.col("turns").alias("turns_c"), F.col("weight").alias("weight_c"), F.col("parent").alias("above"))
    above = forest.select(F.col("node").alias("above"), F.col("weight").alias("weight_d"))
    found = found.join(top, "lca").join(above, "above", "left")
    # counts along the way: down to either end, less what lies above the top twice over
    free = F.col("weight_a") + F.col("weight_b") - F.col("weight_c") - F.coalesce("weight_d", F.lit(0))
    turned = F.col("turns_a") + F.col("turns_b") - 2 * F.col("turns_c")
    return found.select(
        "akey", "bkey", (F.col("pot_b") - F.col("pot_a") - F.col("offset")).alias("holonomy"), "support",
        (F.col("depth_a") + F.col("depth_b") - 2 * F.col("depth_lca") + 1).cast("int").alias("path_nodes"),
        ((free > 0) | (turned > 0) | (F.col("offset") != 0)).alias("effective"), "lca", "depth_a", "depth_b", "depth_lca",
    )


def free_nodes(edges: DataFrame, constant: DataFrame | None = None) -> DataFrame:
    """node, weight: 1 for each end of an equation whose label isn't constant (nkey; unless
    given, of same-sheet nodes)."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("akey").alias("node")), F.struct(F.col("bkey").alias("node"))))).distinct()
    free = ends.where(~F.col("node").startswith("same:")) if constant is None else ends.join(constant.select(F.col("nkey").alias("node")), "node", "left_anti")
    return free.withColumn("weight", F.lit(1).cast("long"))


def cycle_ways(cycles: DataFrame, forest: DataFrame) -> DataFrame:
    """akey, bkey, seq, node: the forest's way from akey (seq 0) to bkey of each cycle."""
    pairs = cycles.select("akey", "bkey", F.col("akey").alias("a"), F.col("bkey").alias("b"), "depth_a", "depth_b", "lca", "depth_lca")
    return ways(pairs, lifts(forest)).select("akey", "bkey", "seq", "node")


def graph_stats(edges: DataFrame, constant: DataFrame | None = None) -> DataFrame:
    """One row: n_nodes, n_edges, n_components, largest_component, and of the fundamental cycles
    how many there are, are effective, don't add up to 0, and are both."""
    edges = durable(edges, "equations")
    forest = spanning_forest(edges, free_nodes(edges, constant))
    cycles = fundamental_cycles(edges, constant, forest)
    sizes = forest.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    of_nodes = sizes.agg(F.coalesce(F.sum("n"), zero).alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.coalesce(F.max("n"), zero).alias("largest_component"))
    of_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    off = F.col("holonomy") != 0
    of_cycles = cycles.agg(F.count(F.lit(1)).alias("n_cycles"), F.count_if("effective").alias("n_effective_cycles"), F.count_if(off).alias("n_nonzero_holonomy"), F.count_if(off & F.col("effective")).alias("n_effective_nonzero_holonomy"))
    return of_nodes.join(of_edges).join(of_cycles)  # one row each


def _tag(kind: str, u: str, v: str, c: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(u), F.lit("/"), F.col(v), F.lit("/"), F.col(c).cast("string"))


def equality_arcs(found: DataFrame, min_support: int) -> DataFrame:
    """u, v, bound, grp, n_links: an equation with enough links gives two inequalities that stand and
    fall together (one grp)."""
    return _both_ways(found.groupBy("akey", "bkey", "a", "b", "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support))


def _both_ways(s: DataFrame) -> DataFrame:
    s = s.withColumn("grp", _tag("equality", "a", "b", "offset"))
    equal = s.select("a", "b", F.col("offset").alias("bound"), "grp", "n").unionAll(s.select("b", "a", -F.col("offset"), "grp", "n"))
    return equal.toDF("u", "v", "bound", "grp", "n_links")


def _far(candidates: DataFrame, spacing: float, margin: float, min_support: int, end: str) -> DataFrame:
    """u, v (what `end` names a node by), bound, n of pairs that order alone tells apart."""
    if not (margin > 0 and margin < float("inf")):
        raise ValueError(f"{margin} is no margin: a number of wraps above 0 is asked for")
    outside = F.col("gap") > 0
    apart = F.abs("gap") > margin * spacing
    if end == "no":  # within a class the arcs from its first node stand for those from its second
        apart = apart & F.when(outside, ~F.col("a.second")).otherwise(~F.col("b.second"))
    far = candidates.where(apart).select(
        F.when(outside, F.col("a." + end)).otherwise(F.col("b." + end)).alias("u"),
        F.when(outside, F.col("b." + end)).otherwise(F.col("a." + end)).alias("v"),
        F.when(outside, F.col("offset") - 1).otherwise(-F.col("offset") - 1).alias("bound"),
    )
    return far.groupBy("u", "v", "bound").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)


def order_arcs(candidates: DataFrame, found: DataFrame, spacing: float, margin: float, min_support: int) -> DataFrame:
    """Inequalities g_v - g_u <= bound: equations' (equality_arcs), and a pair over margin * spacing
    apart tells which lies outside."""
    o = _far(candidates, spacing, margin, min_support, "node")
    return equality_arcs(found, min_support).unionAll(o.select("u", "v", "bound", _tag("order", "u", "v", "bound"), "n"))


def _class_counts(candidates: DataFrame, found: DataFrame, spacing: float, margin: float, min_support: int) -> tuple[DataFrame, DataFrame]:
    """Equations (ano, bno, offset, n) and inequalities (ano, bno, bound, n) between classes, from the
    candidates and links of matching.of_first_nodes."""
    equal = found.groupBy("ano", "bno", "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    return equal, _far(candidates, spacing, margin, min_support, "no").withColumnsRenamed({"u": "ano", "v": "bno"})


def class_arcs(candidates: DataFrame, found: DataFrame, classes: DataFrame, spacing: float, margin: float, min_support: int) -> DataFrame:
    """order_arcs of all nodes, from candidates and links among the first nodes of their classes
    (matching.of_first_nodes) alone: points are compared and counted once for all copies of two nodes."""
    s, o = _class_counts(candidates, found, spacing, margin, min_support)
    equal = _both_ways(matching.least_first(matching.among_members(s, classes), "offset").select("a", "b", "offset", "n"))
    o = matching.among_members(o, classes).select(F.col("a").alias("u"), F.col("b").alias("v"), "bound", "n")
    return equal.unionAll(o.select("u", "v", "bound", _tag("order", "u", "v", "bound"), "n"))


class ClassBounds:
    """The least bounds between classes of nodes, and as arcs of the two nodes of each class whose names
    come first: copies have the same distances in every round of shortest paths, so of several equally
    near nodes the first is always one of those two, and so are all nodes of cycles of parents.

    arcs: u, v (places of names), bound, grp (which kind of arc); names: at, node, id; n and lowest: of
    all nodes with arcs, their number and the sum of their least bounds below 0."""

    def __init__(self, candidates: DataFrame, found: DataFrame, classes: DataFrame, spacing: float, margin: float, min_support: int):
        equal, far = _class_counts(candidates, found, spacing, margin, min_support)
        row = lambda u, v, bound, kind: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), bound.alias("bound"), F.lit(kind).alias("kind"))
        both = equal.select(F.inline(F.array(row("ano", "bno", F.col("offset"), "equality"), row("bno", "ano", -F.col("offset"), "equality"))))
        every = both.unionAll(far.select(row("ano", "bno", F.col("bound"), "order").alias("m")).select("m.*"))
        best = durable(every.groupBy("u", "v").agg(F.min(F.struct("bound", "kind")).alias("m")).select("u", "v", "m.bound", "m.kind"), "class-bounds")
        sizes = classes.groupBy(F.col("no").alias("u")).agg(F.count(F.lit(1)).alias("size"))
        low = best.select("u", "bound").unionAll(best.select("v", F.lit(None).cast("long"))).groupBy("u").agg(F.min("bound").alias("low")).join(sizes, "u")
        self.n, self.lowest = low.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.least(F.col("low"), F.lit(0))), F.lit(0))).first()
        two = classes.withColumn("_i", F.row_number().over(Window.partitionBy("no").orderBy("node"))).where("_i <= 2")
        self.names = durable(matching.placed(two.select("node", "id", "no"), [F.col("node")], "at"), "names")
        side = lambda s: self.names.select(F.col("no").alias(s), F.col("at").alias("at_" + s))
        ends = best.join(side("u"), "u").join(side("v"), "v").where("at_u <> at_v")
        self.arcs = durable(ends.select(F.col("at_u").alias("u"), F.col("at_v").alias("v"), "bound", F.col("kind").alias("grp")), "class-arcs")

    def feasible(self) -> bool:
        """Whether integers meet the bounds of all nodes."""
        return _settled(self.arcs, n=self.n, lowest=self.lowest)[0]

    def negative_cycles(self) -> DataFrame:
        """all_negative_cycles of all nodes' arcs."""
        _, dist, far = _settled(self.arcs, n=self.n, lowest=self.lowest)
        found = negative_cycles(self.arcs, dist, far)
        side = lambda c: self.names.select(F.col("at").alias(c), F.col("node").alias("name_" + c), F.col("id").alias("id_" + c))
        named = found.join(side("u"), "u").join(side("v"), "v").join(side("cycle"), "cycle")
        turned = F.col("id_u") > F.col("id_v")
        pick = lambda x, y: F.when(turned & (F.col("grp") == "equality"), y).otherwise(x)
        # equations are named after their first node
        named = named.withColumns({"_a": pick(F.col("name_u"), F.col("name_v")), "_b": pick(F.col("name_v"), F.col("name_u")), "_c": pick(F.col("bound"), -F.col("bound"))})
        grp = F.when(F.col("grp") == "equality", _tag("equality", "_a", "_b", "_c")).otherwise(_tag("order", "_a", "_b", "_c"))
        return named.select(F.col("name_cycle").alias("cycle"), F.col("name_u").alias("u"), F.col("name_v").alias("v"), "bound", grp.alias("grp"), "total")


def margin_grid(candidates: DataFrame, found: DataFrame, spacing: float, margins: list[float], min_support: int, classes: DataFrame | None = None) -> DataFrame:
    """margin, n_nodes, n_arcs, n_groups, n_point_pairs, n_conflicts: what order_arcs has at each
    margin, and its pairs of nodes with contradicting equations (which no margin changes).

    Pairs of points are grouped once, with a count for each margin. With classes the candidates and links
    are those of matching.of_first_nodes, and what two classes have counts for all pairs of their nodes."""
    grid = sorted(set(margins))
    if not grid or grid[0] <= 0:
        raise ValueError(f"{margins} are no margins: numbers of wraps above 0 are asked for")
    end, ends, key = ("node", ("a", "b"), ["akey", "bkey"]) if classes is None else ("no", ("ano", "bno"), [])
    outside = F.col("gap") > 0
    apart = F.abs("gap") > grid[0] * spacing
    if classes is not None:
        apart = apart & F.when(outside, ~F.col("a.second")).otherwise(~F.col("b.second"))
    far = candidates.where(apart).select(
        F.when(outside, F.col("a." + end)).otherwise(F.col("b." + end)).alias("u"),
        F.when(outside, F.col("b." + end)).otherwise(F.col("a." + end)).alias("v"),
        F.when(outside, F.col("offset") - 1).otherwise(-F.col("offset") - 1).alias("bound"),
        F.abs("gap").alias("apart"),
    )
    levels = range(1, len(grid) + 1)
    counts = [F.count_if(F.col("apart") > F.lit(m * spacing)).alias(f"n{k}") for k, m in zip(levels, grid, strict=True)]
    per = far.groupBy("u", "v", "bound").agg(*counts).where(F.col("n1") >= min_support)
    # counts only fall from margin to margin
    per = durable(per.withColumn("top", sum(((F.col(f"n{k}") >= min_support).cast("int") for k in levels), F.lit(0))), "margins")
    strong = found.groupBy(*key, *ends, "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    strong = durable(strong, "equations")
    if classes is None:
        size = lambda df, c: df.withColumn("of_" + c, F.lit(1).cast("long"))
    else:
        sizes = durable(classes.groupBy("no").agg(F.count(F.lit(1)).alias("n_held")), "sizes")
        size = lambda df, c: df.join(sizes.select(F.col("no").alias(c), F.col("n_held").alias("of_" + c)), c)
    weight = lambda u, v: F.col("of_" + u) * (F.col("of_" + v) - (F.col(u) == F.col(v)).cast("long"))
    zero = F.lit(0).cast("long")
    total = lambda x: F.coalesce(F.sum(x), zero)
    arcs = size(size(per, "u"), "v").withColumn("w", weight("u", "v"))
    sums = arcs.agg(*[total(F.when(F.col("top") >= k, F.col("w"))).alias(f"arcs{k}") for k in levels], *[total(F.when(F.col("top") >= k, F.col("w") * F.col(f"n{k}"))).alias(f"pairs{k}") for k in levels])
    a, b = ends
    pairs = size(size(strong, a), b).withColumn("w", F.when(F.col(a) == F.col(b), weight(a, b) / 2).otherwise(weight(a, b)).cast("long"))
    whole = pairs.agg(total("w").alias("equations"), total(F.col("w") * F.col("n")).alias("links"))
    conflicts = pairs.groupBy(*key, *ends).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).where("n > 1").agg(total("w").alias("n_conflicts"))
    both = lambda df, u, v, at: df.select(F.inline(F.array(F.struct(F.col(u).alias("node"), at.alias("top")), F.struct(F.col(v).alias("node"), at.alias("top")))))
    nodes = both(per, "u", "v", F.col("top")).unionAll(both(strong, a, b, F.lit(len(grid)))).groupBy("node").agg(F.max("top").alias("top"))
    held = size(nodes, "node").agg(*[total(F.when(F.col("top") >= k, F.col("of_node"))).alias(f"nodes{k}") for k in levels])
    one = sums.join(whole).join(conflicts).join(held)  # one row each
    rows = [
        F.struct(
            F.lit(float(m)).alias("margin"), F.col(f"nodes{k}").alias("n_nodes"), (2 * F.col("equations") + F.col(f"arcs{k}")).alias("n_arcs"),
            (F.col("equations") + F.col(f"arcs{k}")).alias("n_groups"), (F.col("links") + F.col(f"pairs{k}")).alias("n_point_pairs"), "n_conflicts",
        )
        for k, m in zip(levels, grid, strict=True)
    ]
    return one.select(F.inline(F.array(*rows)))


def all_negative_cycles(arcs: DataFrame) -> DataFrame:
    """negative_cycles of the distances that feasible ends with."""
    _, dist, far = _settled(arcs)
    return negative_cycles(arcs, dist, far)


def conflict_endpoints(arcs: DataFrame) -> DataFrame:
    """Pairs of nodes with more than one equality group."""
    e = arcs.where(F.col("grp").startswith("equality:") & (F.col("u") < F.col("v")))
    return e.groupBy("u", "v").agg(F.count_distinct("grp").alias("n_groups")).where("n_groups > 1")


def _far_parents(now: DataFrame, n: int) -> DataFrame:
    """node, up: where n steps or more from node to parent (null where none) lead, by doubling the
    stride. Among n nodes so many steps end on a cycle. Three doublings are one job."""
    at = now.select("node", F.col("parent").alias("up")).where("up is not null")
    for k in range(n.bit_length()):
        at = at.join(at.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))
        if k % 3 == 2 or k + 1 == n.bit_length():
            at = durable(at, "parents")
            if at.isEmpty():
                break
    return at


def feasible(arcs: DataFrame, rounds: int | None = None) -> tuple[bool, DataFrame]:
    """Whether integers meet all bounds, and node, dist, parent after the last round of
    shortest paths from a source before all nodes. A change in round n (the number of
    nodes), a distance below any simple path's sum, or parents (the arc of a node's last
    change) that come round shows a negative cycle; parents are looked at after 4, 8, 16, ...
    rounds. Raises where neither is shown within `rounds`, if given."""
    return _settled(arcs, rounds)[:2]


def _settled(arcs: DataFrame, rounds: int | None = None, n: int | None = None, lowest: int | None = None) -> tuple[bool, DataFrame, DataFrame | None]:
    """feasible, and the far parents that showed a cycle, if they did. n and lowest, if given, are those
    of a larger graph that the arcs stand for: its nodes, and the sum of their least bounds below 0."""
    best = durable(arcs.groupBy("u", "v").agg(F.min("bound").alias("bound")), "bounds")
    now = durable(best.select(F.col("u").alias("node")).unionAll(best.select("v")).distinct().withColumn("dist", F.lit(0).cast("long")), "distances")
    now = now.withColumn("parent", F.lit(None).cast(best.schema["u"].dataType))
    n = now.count() if n is None else n
    if lowest is None:
        lowest = best.groupBy("u").agg(F.min("bound").alias("b")).agg(F.sum(F.least("b", F.lit(0)))).first()[0] or 0
    done, look = 0, 4
    while rounds is None or done < rounds:
        via = best.join(now.select(F.col("node").alias("u"), "dist"), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("bound")).alias("near"), "u")).alias("m"))
        nearer = F.coalesce(F.col("m.near") < F.col("dist"), F.lit(False))
        stepped = now.join(via, "node", "left").select("node", F.col("dist").alias("was"), F.when(nearer, F.col("m.near")).otherwise(F.col("dist")).alias("dist"), F.when(nearer, F.col("m.u")).otherwise(F.col("parent")).alias("parent"))
        new = durable(stepped, "distances")
        now = new.select("node", "dist", "parent")
        done += 1
        state = new.agg(F.count_if(F.col("dist") != F.col("was")).alias("changed"), F.min("dist").alias("low")).first()
        if not state["changed"]:
            return True, now, None
        if done >= n or state["low"] < lowest:
            return False, now, None
        if done == look:
            look *= 2
            far = _far_parents(now, n)
            if not far.isEmpty():
                return False, now, far
    raise ValueError(f"neither settled nor shown infeasible in {rounds} rounds")


def negative_cycles(arcs: DataFrame, dist: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """cycle (its least node), u, v, bound, grp, total: cycles of arcs whose bounds add up to less
    than 0, from the distances of an infeasible system; none of a feasible one. Parents that come
    round are such cycles, and no two of them share a node. far: dist's far parents, if known."""
    near = dist.select("node", "parent")
    far = _far_parents(near, near.count()) if far is None else far
    on = far.select(F.col("up").alias("node")).distinct()
    steps = durable(near.join(on, "node").select(F.col("parent").alias("u"), F.col("node").alias("v")), "steps")
    named = connected_components(steps.select(F.col("v").alias("node")).withColumn("label", F.col("node")), steps.select(F.col("u").alias("a"), F.col("v").alias("b")))
    best = arcs.groupBy("u", "v").agg(F.min(F.struct("bound", "grp")).alias("m"))
    found = steps.join(best, ["u", "v"]).join(named.select(F.col("node").alias("v"), F.col("label").alias("cycle")), "v")
    return found.select("cycle", "u", "v", "m.bound", "m.grp", F.sum("m.bound").over(Window.partitionBy("cycle")).alias("total"))
