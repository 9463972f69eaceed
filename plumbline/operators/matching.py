"""Links between nodes: a binned spatial self-join with a crowding veto, and the integer
equations that the links add up to.

Points meet through sector cells. Two points close enough to link are in one cell or in
neighbouring ones, so each unordered pair meets exactly once: from one point's cell to a
forward neighbour of it. Whether a pair may link depends on cells only (a centre cell
with its forward neighbours is vetoed if it is crowded, and a pair needs one open centre
that holds both cells), so cell pairs are decided before points are joined.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import TWO_PI, cut_crossing, label_diff, projected_gap, sector_cell, theta_cells, wrap_angle
from plumbline.operators.audit import STRICT_DZ
from plumbline.operators.components import durable
from plumbline.operators.ranking import placed
from plumbline.operators.settings import AuditConfig

#: What of a point tells gaps and offsets.
PLACES = ("theta", "r", "z", "label", "slope")
#: Cells of a neighbourhood, as steps from its centre.
FORWARD = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
#: Nodes of a class in one row, where pairs of classes become pairs of nodes.
MEMBERS = 64


def _steps(steps) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_cells(sloped: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Seam-safe points with their sector cell zi, ti."""
    n = theta_cells(cfg.sector_dtheta_rad)
    if TWO_PI / n < cfg.sector_dtheta_rad * (1 - 1e-9):
        raise ValueError("cells must be as wide as the sector: take a width that divides the circle")
    zi, ti = sector_cell(F.col("theta"), F.col("z"), cfg.sector_dz, cfg.sector_dtheta_rad)
    return sloped.where("seam_safe").withColumn("zi", zi).withColumn("ti", ti)


def neighbourhoods(cells: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Each point in every centre (cz, ct) whose neighbourhood holds its cell, with own: whether
    the centre is its cell."""
    n = theta_cells(cfg.sector_dtheta_rad)
    spread = cells.withColumn("_s", F.explode(_steps(FORWARD))).withColumn("cz", F.col("zi") - F.col("_s.i")).withColumn("ct", F.pmod(F.col("ti") - F.col("_s.j"), F.lit(n)))
    return spread.withColumn("own", (F.col("_s.i") == 0) & (F.col("_s.j") == 0)).drop("_s")


def referred(cells: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Each point in every centre around it that isn't empty, with z_ref and theta_ref: the
    neighbourhood's median z and the angle of the centre's first point."""
    hood = neighbourhoods(cells.select("nkey", "pid", "theta", "r", "z", "label", "slope", "zi", "ti"), cfg)
    at = Window.partitionBy("cz", "ct")
    first = F.min(F.when(F.col("own"), F.struct("nkey", "pid", "theta", "label"))).over(at)
    return hood.withColumn("ref", first).withColumn("z_ref", F.percentile("z", 0.5).over(at)).where("ref is not null").withColumn("theta_ref", F.col("ref.theta"))


def crowding(hood: DataFrame, cfg: AuditConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """cz, ct, nkey (and by), crowded of each sheet: whether the node's next label lies closer
    than the crowding floor there."""
    h = hood.withColumn("_label", F.col("label") + F.lit(cfg.sense) * cut_crossing(F.col("theta"), F.col("theta_ref")))
    h = h.withColumn("_r", F.col("r") + F.coalesce(F.col("slope") * (F.col("z_ref") - F.col("z")), F.lit(0.0)))
    keys = [*by, "cz", "ct", "nkey"]
    sheets = h.groupBy(*keys, "_label").agg(F.min("_r").alias("inner"), F.max("_r").alias("outer"))
    s = sheets.withColumn("_n", F.lead(F.struct("_label", "inner")).over(Window.partitionBy(*keys).orderBy("_label")))
    crowded = (F.col("_n._label") - F.col("_label") == 1) & (F.abs(F.col("_n.inner") - F.col("outer")) < cfg.crowd_min_spacing)
    return s.select(*keys, F.coalesce(crowded, F.lit(False)).alias("crowded"))


def centre_references(cells: DataFrame, cfg: AuditConfig) -> DataFrame:
    """cz, ct, z_ref, theta_ref of every centre that isn't empty, as referred has them. Only heights
    travel to all centres around a point, and those that are equal together."""
    hood = neighbourhoods(cells.select("nkey", "pid", "theta", "label", "z", "zi", "ti"), cfg)
    first = F.min(F.when(F.col("own"), F.struct("nkey", "pid", "theta", "label"))).alias("ref")
    g = hood.groupBy("cz", "ct").agg(first, F.percentile("z", 0.5).alias("z_ref")).where("ref is not null")
    return g.select("cz", "ct", "z_ref", F.col("ref.theta").alias("theta_ref"))


def crowded_centres(cells: DataFrame, cfg: AuditConfig) -> DataFrame:
    """cz, ct, vetoed of every centre that isn't empty: vetoed if a node has two successive labels
    there whose sheets, brought to the neighbourhood's median z, come closer than the crowding
    floor. A node with one point there has one label, so only points of nodes that have several
    are dealt by centre; which those are is found node by node."""
    refs = durable(centre_references(cells, cfg), "references")
    by_node = cells.select("nkey", "pid", "theta", "r", "z", "label", "slope", "zi", "ti").repartition("nkey")
    several = neighbourhoods(by_node, cfg).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("nkey", "cz", "ct"))).where("_n > 1").drop("_n")
    crowded = crowding(several.join(refs, ["cz", "ct"]), cfg).groupBy("cz", "ct").agg(F.max("crowded").alias("vetoed"))
    return refs.select("cz", "ct").join(crowded, ["cz", "ct"], "left").withColumn("vetoed", F.coalesce("vetoed", F.lit(False)))


def cell_pairs(cells: DataFrame) -> DataFrame:
    """Occupied cells za, ta with the steps di, dj to themselves and their forward neighbours."""
    occupied = cells.select("zi", "ti").distinct()
    return occupied.withColumn("_s", F.explode(_steps(FORWARD))).select(F.col("zi").alias("za"), F.col("ti").alias("ta"), F.col("_s.i").alias("di"), F.col("_s.j").alias("dj"))


def holding_centres(pairs: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Each pair of cells with every centre cz, ct whose neighbourhood holds both."""
    n = theta_cells(cfg.sector_dtheta_rad)
    # as steps from the first cell: those where both steps are forward ones
    shared = {d: [(-i, -j) for i, j in FORWARD if (i + d[0], j + d[1]) in FORWARD] for d in FORWARD}
    options = F.array(*[F.struct(F.lit(d[0]).alias("di"), F.lit(d[1]).alias("dj"), F.lit(i).alias("i"), F.lit(j).alias("j")) for d, at in shared.items() for i, j in at])
    tries = pairs.withColumn("_o", F.explode(options)).where("_o.di = di and _o.dj = dj")
    return tries.withColumn("cz", F.col("za") + F.col("_o.i")).withColumn("ct", F.pmod(F.col("ta") + F.col("_o.j"), F.lit(n))).drop("_o")


def _meetings(cells: DataFrame, cfg: AuditConfig, centres: DataFrame | None) -> DataFrame:
    """Pairs of cells. With centres (cz, ct, vetoed) only those that an open centre holds
    together; those are written, as both sides of a join look at them."""
    pairs = cell_pairs(cells)
    if centres is None:
        return pairs
    held = holding_centres(pairs, cfg).join(centres.where("not vetoed"), ["cz", "ct"], "left_semi")
    return durable(held.select("za", "ta", "di", "dj").distinct(), "meetings")


def band_pairs(cells: DataFrame, cfg: AuditConfig, centres: DataFrame | None, ordered: bool = True) -> DataFrame:
    """Pairs a, b of points of different nodes within the sector band, with their pair of cells za,
    ta, di, dj; the first of a pair has the smaller node, unless they may stand as they met. Of cells
    that of_first_nodes has, second nodes meet the first of their class alone."""
    n = theta_cells(cfg.sector_dtheta_rad)
    classed = "no" in cells.columns
    cols = ("nkey", "node", "pid", "theta", "r", "z", "label", "slope", *(("no", "second") if classed else ()))
    side = lambda s: cells.select(F.col("zi").alias("z" + s), F.col("ti").alias("t" + s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    m = _meetings(cells, cfg, centres).withColumn("zb", F.col("za") + F.col("di")).withColumn("tb", F.pmod(F.col("ta") + F.col("dj"), F.lit(n)))
    b = side("b")
    if centres is not None:  # what no open centre holds needn't be shuffled; cells are few
        b = b.join(m.select("zb", "tb").distinct(), ["zb", "tb"], "left_semi")
    # few and small files make many pairs: these are dealt over as many tasks as a shuffle has, and
    # joined by sorting, as one function for broadcasts and all that follows is too long to be compiled
    met = side("a").join(m, ["za", "ta"]).repartition(shuffle_tasks(cells), "zb", "tb").join(b.hint("merge"), ["zb", "tb"])
    once = (F.col("nkey_a") != F.col("nkey_b")) & ((F.col("di") != 0) | (F.col("dj") != 0) | (F.col("nkey_a") < F.col("nkey_b")))
    near = (F.abs(F.col("z_a") - F.col("z_b")) <= cfg.sector_dz) & (F.abs(wrap_angle(F.col("theta_a") - F.col("theta_b"))) <= F.lit(cfg.sector_dtheta_rad))
    if classed:  # a second node stands for pairs within its class alone
        once = once & (~(F.col("second_a") | F.col("second_b")) | (F.col("no_a") == F.col("no_b")))
    met = met.where(near & once)
    if not ordered:
        return met.select("za", "ta", "di", "dj", *[F.struct(*[F.col(f"{c}_{x}").alias(c) for c in cols]).alias(x) for x in "ab"])
    met = met.withColumn("_swap", F.col("nkey_a") > F.col("nkey_b"))
    # column by column, so that what isn't asked of a pair isn't made
    turned = lambda s, t: F.struct(*[F.when(F.col("_swap"), F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(c) for c in cols]).alias(s)
    return met.select("za", "ta", "di", "dj", turned("a", "b"), turned("b", "a"))


def compared(pairs: DataFrame, cfg: AuditConfig) -> DataFrame:
    """pairs with gap and offset; those whose radii can't be compared go."""
    of = lambda s: {c: F.col(f"{s}.{c}") for c in ("r", "z", "slope")}
    met = pairs.withColumn("gap", projected_gap(of("a"), of("b"), STRICT_DZ)).where("gap is not null")
    offset = label_diff(F.col("a.label"), F.col("a.theta"), F.col("b.label"), F.col("b.theta"), cfg.sense)
    return met.withColumn("offset", offset)


def candidate_pairs(cells: DataFrame, cfg: AuditConfig, centres: DataFrame | None, ordered: bool = True) -> DataFrame:
    """Comparable pairs of points of different nodes within the sector band; the first of a pair
    has the smaller node if they are ordered. Columns a_*, b_*, gap, offset; both only change their
    sign where a pair is turned round."""
    return compared(band_pairs(cells, cfg, centres, ordered).select("a", "b"), cfg)


def node_classes(cells: DataFrame, places: tuple[str, ...] = PLACES) -> DataFrame:
    """nkey, node, cls, id, no (durable): nodes whose points agree in `places`, as often, are one class,
    named by its least node; id is the node's place in order of nkey, no that of its class's least
    node. Sums of hashes propose a class, and a node joins it only if its places are the least
    node's, one by one; what is counted between two classes then holds for all their nodes."""
    spots = durable(cells.groupBy("nkey", "node", *places).agg(F.count(F.lit(1)).alias("n")), "spots")
    mark = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), *places, "n"), 24))
    marks = ["n_spots", "mark", "mark2"]
    marked = durable(spots.groupBy("nkey", "node").agg(F.count(F.lit(1)).alias("n_spots"), mark(1).alias("mark"), mark(2).alias("mark2")), "marks")
    named = marked.join(marked.groupBy(*marks).agg(F.min("nkey").alias("first")), marks)
    own = spots.join(named.where("nkey <> first").select("nkey", "first"), "nkey").select("nkey", "first", *places, "n")
    firsts = spots.select(F.col("nkey").alias("first"), *[F.col(c).alias(c + "_f") for c in places], F.col("n").alias("n_f"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(c + "_f")), (*places, "n"), own["first"] == firsts["first"])
    alike = own.join(firsts, same, "left_semi").groupBy("nkey").agg(F.count(F.lit(1)).alias("n_alike"))
    cls = F.when(F.col("n_alike") == F.col("n_spots"), F.col("first")).otherwise(F.col("nkey"))
    ranked = durable(placed(named.join(alike, "nkey", "left").select("nkey", "node", cls.alias("cls")), [F.col("nkey")], "id"), "classes")
    own_no = ranked.where("nkey = cls").select("cls", F.col("id").alias("no"))
    return durable(ranked.join(own_no, "cls").select("nkey", "node", "cls", "id", "no"), "classes")


def first_nodes(classes: DataFrame) -> DataFrame:
    """nkey, no, second of the first two nodes of each class: pairs of first ones stand for two classes,
    a first with its second one for the pairs within a class."""
    second = classes.where("id <> no").groupBy("no").agg(F.min("nkey").alias("nkey"))
    return second.select("nkey", "no", F.lit(True).alias("second")).unionAll(classes.where("id = no").select("nkey", "no", F.lit(False)))


def of_first_nodes(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """The points of first_nodes alone, with no and second."""
    return durable(cells.join(first_nodes(classes), "nkey"), "first-nodes")


def among_members(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (ano, bno and more) of classes as pairs of all their nodes, a, b by name and aid, bid by id.
    Two classes' nodes meet as the pair has them; within a class each meets each other, both ways.
    Members are held MEMBERS a row, so pairs are made where the classes' pair lies; output is made
    in as many tasks as a shuffle has, however few rows go in. pairs are written before."""
    pairs = durable(pairs, "class-pairs")
    at = F.row_number().over(Window.partitionBy("no").orderBy("id")) - 1
    dealt = classes.select("no", F.struct("id", "node").alias("m"), F.floor(at / MEMBERS).alias("block"))
    blocks = durable(dealt.groupBy("no", "block").agg(F.collect_list("m").alias("ms")).select("no", "ms"), "members")
    side = lambda s: blocks.select(F.col("no").alias(s + "no"), F.col("ms").alias(s + "s"))
    met = pairs.repartition(shuffle_tasks(classes), "ano", "bno").join(side("a"), "ano").join(side("b"), "bno")
    each = met.withColumn("_a", F.explode("as")).drop("as").withColumn("_b", F.explode("bs")).drop("bs").where("_a.id <> _b.id")
    ends = {"a": F.col("_a.node"), "b": F.col("_b.node"), "aid": F.col("_a.id"), "bid": F.col("_b.id")}
    return each.withColumns(ends).drop("_a", "_b")


def least_first(pairs: DataFrame, *negated: str) -> DataFrame:
    """pairs of among_members, each once, the node with the smaller key first; the columns `negated` turn
    where that changes a pair's order."""
    once = pairs.where((F.col("aid") < F.col("bid")) | (F.col("ano") != F.col("bno")))
    turned = F.col("aid") > F.col("bid")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    ends = {"a": pick("a", "b"), "b": pick("b", "a")}
    return once.withColumns(ends | {c: F.when(turned, -F.col(c)).otherwise(F.col(c)) for c in negated}).drop("ano", "bno", "aid", "bid")


def as_links(pairs: DataFrame, *more: str) -> DataFrame:
    """Compared pairs as equations g_b - g_a = offset between two points, the smaller node first; with
    the nodes' classes ano, bno where points have them."""
    turned = F.col("a.nkey") > F.col("b.nkey")
    end = lambda x, y, c: F.when(turned, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    # 0 - 0 is 0, as it is the other way round
    signed = lambda c: F.when(turned, 0 - F.col(c)).otherwise(F.col(c)).alias(c)
    classes = [end("a", "b", "no").alias("ano"), end("b", "a", "no").alias("bno")] if "no" in pairs.schema["a"].dataType.names else []
    return pairs.select(
        *more, *classes, end("a", "b", "node").alias("a"), end("b", "a", "node").alias("b"), end("a", "b", "nkey").alias("akey"), end("b", "a", "nkey").alias("bkey"),
        end("a", "b", "pid").alias("pid_a"), end("b", "a", "pid").alias("pid_b"), signed("offset"), signed("gap"), (F.abs(F.col("a.theta") - F.col("b.theta")) > math.pi).alias("over_cut"),
    )


def links(cells: DataFrame, cfg: AuditConfig, centres: DataFrame | None = None) -> DataFrame:
    """Same-sheet equations g_b - g_a = offset between two points. Pairs are compared as they met and
    turned once they are few."""
    centres = crowded_centres(cells, cfg) if centres is None else centres
    return as_links(candidate_pairs(cells, cfg, centres, ordered=False).where(F.abs("gap") <= cfg.r_same))


def offset_support(found: DataFrame, cfg: AuditConfig) -> DataFrame:
    """a, b, offset, support of each equation, whether it has enough links (supported), and how
    many equations of the pair have (n_supported)."""
    g = found.groupBy("akey", "bkey", "a", "b", "offset").agg(F.count(F.lit(1)).alias("support"))
    g = g.withColumn("supported", F.col("support") >= cfg.min_edge_support)
    return g.withColumn("n_supported", F.count_if("supported").over(Window.partitionBy("akey", "bkey")))


def edges(found: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Pairs with exactly one supported offset."""
    return offset_support(found, cfg).where("supported and n_supported = 1").select("a", "b", "akey", "bkey", "offset", "support")


def conflicts(found: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Pairs with several supported offsets."""
    g = offset_support(found, cfg).where("supported and n_supported > 1").groupBy("a", "b", "akey", "bkey")
    return g.agg(F.sort_array(F.collect_list("offset")).alias("offsets"), F.sum("support").alias("n_links"))


def match_stats(cells: DataFrame, centres: DataFrame, found: DataFrame, cfg: AuditConfig) -> DataFrame:
    """One row of counters. Links over the cut are counted before the support rule."""
    points = cells.agg(F.count(F.lit(1)).alias("n_points"), F.count("slope").alias("n_points_with_slope"))
    c = centres.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("vetoed").alias("n_vetoed_cells"))
    k = found.agg(F.count(F.lit(1)).alias("n_links"), F.count_if("over_cut").alias("n_cut_links"))
    s = offset_support(found, cfg).agg(
        F.coalesce(F.sum(F.when(~F.col("supported"), F.col("support"))), F.lit(0)).alias("n_unsupported_links"),
        F.count_if(F.col("supported") & (F.col("n_supported") == 1)).alias("n_edges"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(points).join(one(c), "_one").join(one(k), "_one").join(one(s), "_one").drop("_one")
