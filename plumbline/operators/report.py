"""What an audit reports of itself: counts of the corpus and of its coverage, boundaries where a
planted defect could be seen, the support of links near the threshold, and the exposure of gaps
to the cut."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import cut_crossing, gap_width, label_diff
from plumbline.operators.components import connected_components, durable
from plumbline.operators.controls import MIN_CHAIN
from plumbline.operators.forest import spanning_forest
from plumbline.operators.graph import cycle_ways, free_nodes

LABELLED = ("relative", "absolute")
TIGHT, LOOSE = 0.25, 0.35


def _kind(key: str) -> Column:
    return F.substring_index(key, ":", 1)


def corpus_stats(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per kind: collections and points, and of its nodes how many there are, cross the cut or
    aren't safe at the seam."""
    of_points = points.groupBy("kind").agg(F.count_distinct("cid").alias("n_collections"), F.count(F.lit(1)).alias("n_points"))
    per_node = nodes.groupBy("kind", "nkey").agg(F.max(F.col("crossings") != 0).alias("crosses"), F.min("seam_safe").alias("safe"))
    of_nodes = per_node.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("crosses").alias("n_crossing"), F.count_if(~F.col("safe")).alias("n_seam_unsafe"))
    return of_points.join(of_nodes, "kind", "left").na.fill(0)


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per kind: nodes, and how many of them an equation reaches."""
    reached = edges.select(F.inline(F.array(F.struct(F.col("akey").alias("nkey")), F.struct(F.col("bkey").alias("nkey"))))).distinct()
    n = nodes.select("kind", "nkey").distinct().join(reached.withColumn("linked", F.lit(True)), "nkey", "left")
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("linked").alias("n_linked"))


def _ends(links: DataFrame) -> DataFrame:
    side = lambda k, p, i: F.struct(F.col(k).alias("nkey"), F.col(p).alias("partner"), F.col(i).alias("pid"))
    return links.select(F.inline(F.array(side("akey", "bkey", "pid_a"), side("bkey", "akey", "pid_b"))))


def partner_spans(chains: DataFrame, links: DataFrame, min_support: int) -> DataFrame:
    """nkey, partner, left_from, right_to: a chain's boundary (points before it) has enough links
    to the partner on its left from left_from on, and on its right up to right_to."""
    at = _ends(links).join(chains.select("nkey", "pid", "at"), ["nkey", "pid"])
    up, down = (Window.partitionBy("nkey", "partner").orderBy(o, "pid") for o in (F.col("at"), F.col("at").desc()))
    ranked = at.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    least, most = (F.max(F.when(F.col(c) == min_support, F.col("at"))) for c in ("_up", "_down"))
    return ranked.groupBy("nkey", "partner").agg(least.alias("left_from"), (most - 1).alias("right_to")).where("left_from is not null")


def without_chain(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """nkey, partner, grp, labelled: which partners of a chain hang together when the chain is
    taken out, and whether a labelled node of the equations is among what they hang on. All
    chains are scenarios of one job; a scenario holds the components of the chain's partners, so
    the work is that of the components' sizes times the chains that ask for them."""
    e = durable(edges.select(F.col("akey").alias("a"), F.col("bkey").alias("b")), "equations")
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node"))))).distinct()
    comp = connected_components(ends.withColumn("label", F.col("node")), e)
    chains = spans.groupBy("nkey").agg(F.min("left_from").alias("_l"), F.max("right_to").alias("_r")).where("_l <= _r").select("nkey")
    # a partner with contradicting offsets is no neighbour by equations, and may be elsewhere
    asked = spans.join(chains, "nkey").join(comp.withColumnRenamed("node", "partner"), "partner").select("nkey", "label").distinct()
    scene = asked.join(e.join(comp.withColumnRenamed("node", "a"), "a"), "label").where("a <> nkey and b <> nkey")
    name = lambda c: F.concat_ws("#", "nkey", c)
    mates = asked.join(comp, "label").where("node <> nkey").select("nkey", "node")
    others = spans.select("nkey", F.col("partner").alias("node")).join(chains, "nkey")
    members = durable(mates.unionAll(others).distinct(), "members")
    found = connected_components(members.select(name("node").alias("node")).withColumn("label", F.col("node")), scene.select(name("a").alias("a"), name("b").alias("b")))
    known = members.join(ends.select("node", F.lit(True).alias("_in")), "node", "left").withColumn("_at", name("node"))
    known = known.join(found.select(F.col("node").alias("_at"), F.col("label").alias("grp")), "_at")
    labels = known.groupBy("grp").agg(F.coalesce(F.max(F.col("_in") & _kind("node").isin(*LABELLED)), F.lit(False)).alias("labelled"))
    return known.join(labels, "grp").select("nkey", F.col("node").alias("partner"), "grp", "labelled").join(spans.select("nkey", "partner"), ["nkey", "partner"], "left_semi")


def boundary_sites(nodes: DataFrame, links: DataFrame, edges: DataFrame, min_support: int) -> DataFrame:
    """nkey, boundary, n_left, n_right, reachable of every inner boundary of chains of MIN_CHAIN
    points or more: partners with enough links on either side, and whether something beside
    the chain joins a left partner with a right one (for same-sheet chains something that has
    labels). Counts run along a chain's boundaries, so a chain isn't crossed with its partners."""
    by = Window.partitionBy("nkey")
    chains = nodes.where("kind <> 'absolute'").withColumn("at", F.row_number().over(by.orderBy("pid"))).withColumn("n", F.count(F.lit(1)).over(by))
    chains = durable(chains.where(F.col("n") >= MIN_CHAIN).select("nkey", "pid", "kind", "at", "n"), "chains")
    spans = durable(partner_spans(chains, links, min_support), "spans")
    groups = spans.join(without_chain(spans, edges), ["nkey", "partner"]).groupBy("nkey", "grp", "labelled").agg(F.min("left_from").alias("lo"), F.max("right_to").alias("hi"))
    groups = groups.where((F.col("lo") <= F.col("hi")) & (F.col("labelled") | (_kind("nkey") == "relative")))

    def step(at: Column, left: int, right: int, joined: int) -> Column:
        return F.struct(at.cast("int").alias("boundary"), F.lit(left).alias("l"), F.lit(right).alias("r"), F.lit(joined).alias("j"), F.lit(False).alias("own"))

    right = F.when(F.col("right_to") >= 1, F.array(step(F.lit(1), 0, 1, 0), step(F.col("right_to") + 1, 0, -1, 0))).otherwise(F.array())
    changes = [
        spans.select("nkey", F.inline(F.concat(F.array(step(F.col("left_from"), 1, 0, 0)), right))),
        groups.select("nkey", F.inline(F.array(step(F.col("lo"), 0, 0, 1), step(F.col("hi") + 1, 0, 0, -1)))),
        chains.where("at < n").select("nkey", F.col("at").alias("boundary"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("j"), F.lit(True).alias("own")),
    ]
    per = reduce(DataFrame.unionAll, changes).groupBy("nkey", "boundary").agg(*[F.sum(c).alias(c) for c in "lrj"], F.max("own").alias("own"))
    along = Window.partitionBy("nkey").orderBy("boundary").rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("nkey", "boundary", "own", *[F.sum(c).over(along).alias(c) for c in "lrj"])
    return run.where("own").select("nkey", "boundary", F.col("l").alias("n_left"), F.col("r").alias("n_right"), (F.col("j") > 0).alias("reachable"))


def band_census(links: DataFrame, edges: DataFrame, spacing: float, min_support: int, tight: float = TIGHT, loose: float = LOOSE) -> DataFrame:
    """One row: links, those in the band between the two tolerances (in wraps), equations that
    have some there or nothing else, and equations left under the tighter tolerance."""
    inner = F.abs("gap") <= F.lit(tight * spacing)
    counted = links.where(F.abs("gap") <= F.lit(loose * spacing)).groupBy("akey", "bkey", "offset").agg(F.count(F.lit(1)).alias("n"), F.count_if(inner).alias("n_inner"))
    per = counted.join(edges.select("akey", "bkey", "offset", F.lit(True).alias("edge")), ["akey", "bkey", "offset"], "left").withColumn("edge", F.coalesce("edge", F.lit(False)))
    strong = Window.partitionBy("akey", "bkey")
    per = per.withColumn("_k", F.count_if(F.col("n_inner") >= min_support).over(strong))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.col("n") - F.col("n_inner")), F.lit(0)).alias("n_band_links"),
        F.count_if(F.col("edge") & (F.col("n") > F.col("n_inner"))).alias("n_band_edges"),
        F.count_if(F.col("edge") & (F.col("n_inner") == 0)).alias("n_only_band_edges"),
        F.count_if((F.col("n_inner") >= min_support) & (F.col("_k") == 1)).alias("n_tight_edges"),
    )


def cut_exposure(gaps: DataFrame, a: str, b: str) -> DataFrame:
    """One row: number, mean and greatest width of the gaps between angles a and b, how many of
    them a ray at a uniform angle is expected to straddle, and the chance of one at least."""
    w = gaps.select(gap_width(F.col(a), F.col(b)).alias("w"))
    expected = F.coalesce(F.sum("w"), F.lit(0.0)) / F.lit(2 * math.pi)
    return w.agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("w").alias("mean_width"), F.max("w").alias("max_width"), expected.alias("expected"), (1 - F.exp(-expected)).alias("probability"))


def gauge_differences(links: DataFrame, points: DataFrame, turned: DataFrame, sense: int) -> DataFrame:
    """a, b, n_links, n_changed, n_off: how links' offsets change when every point's angle does,
    and how many change by something else than the difference of their nodes' own gauges (the
    cuts that a node's first point moves over). turned: pid, label, theta in the new frame."""
    moved = points.select("nkey", "pid", "theta").join(turned.select("pid", F.col("label").alias("label_t"), F.col("theta").alias("theta_t")), "pid")
    moved = moved.withColumn("_cut", F.lit(sense) * cut_crossing(F.col("theta"), F.col("theta_t")))
    moved = moved.withColumn("gauge", F.first("_cut").over(Window.partitionBy("nkey").orderBy("pid")))
    side = lambda s: moved.select(F.col("nkey").alias(s + "key"), F.col("pid").alias("pid_" + s), *[F.col(c).alias(c + s) for c in ("label_t", "theta_t", "gauge")])
    both = links.join(side("a"), ["akey", "pid_a"]).join(side("b"), ["bkey", "pid_b"])
    change = label_diff(F.col("label_ta"), F.col("theta_ta"), F.col("label_tb"), F.col("theta_tb"), sense) - F.col("offset")
    both = both.withColumn("change", change)
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("change") != 0).alias("n_changed"), F.count_if(F.col("change") != F.col("gaugeb") - F.col("gaugea")).alias("n_off"))


def implicated_nodes(conflicts: DataFrame, quarantined: DataFrame) -> DataFrame:
    """nkey, in_conflict, in_quarantine of the nodes that an alarm names."""
    ends = conflicts.select(F.inline(F.array(F.struct(F.col("akey").alias("nkey")), F.struct(F.col("bkey").alias("nkey")))))
    named = ends.select("nkey", F.lit(True).alias("c"), F.lit(False).alias("q")).unionAll(quarantined.select("nkey", F.lit(False), F.lit(True)))
    return named.groupBy("nkey").agg(F.max("c").alias("in_conflict"), F.max("q").alias("in_quarantine"))


def cycle_certificates(cycles: DataFrame, edges: DataFrame, forest: DataFrame | None = None) -> DataFrame:
    """akey, bkey, seq, from_key, to_key, contribution: the way round each cycle that doesn't
    close, first its closing edge from a to b (seq 0), then back along the forest. The
    contributions of a cycle add up to what is left over, not to 0."""
    bad = durable(cycles.where("holonomy <> 0"), "bad-cycles")
    forest = spanning_forest(edges, free_nodes(edges)) if forest is None else forest
    # the way runs from a to b; the way back runs from b to a
    ways = cycle_ways(bad, forest).join(bad.select("akey", "bkey", "path_nodes"), ["akey", "bkey"])
    ways = durable(ways.select("akey", "bkey", (F.col("path_nodes") - F.col("seq")).cast("int").alias("seq"), "node"), "ways")
    after = ways.select("akey", "bkey", (F.col("seq") - 1).alias("seq"), F.col("node").alias("to_key"))
    back = ways.withColumnRenamed("node", "from_key").join(after, ["akey", "bkey", "seq"]).select("akey", "bkey", "seq", "from_key", "to_key")
    every = bad.select("akey", "bkey", F.lit(0).alias("seq"), F.col("akey").alias("from_key"), F.col("bkey").alias("to_key")).unionAll(back)
    ways = F.array(F.struct(F.col("akey").alias("from_key"), F.col("bkey").alias("to_key"), F.col("offset").alias("contribution")), F.struct(F.col("bkey").alias("from_key"), F.col("akey").alias("to_key"), (-F.col("offset")).alias("contribution")))
    return every.join(edges.select(F.inline(ways)), ["from_key", "to_key"]).select("akey", "bkey", "seq", "from_key", "to_key", "contribution")


def cycle_witnesses(cycles: DataFrame, links: DataFrame) -> DataFrame:
    """akey, bkey, pid_a, pid_b, offset, gap: the links behind the closing edge of each cycle that
    doesn't close."""
    bad = cycles.where("holonomy <> 0").select("akey", "bkey")
    return links.join(bad, ["akey", "bkey"], "left_semi").select("akey", "bkey", "pid_a", "pid_b", "offset", "gap")
