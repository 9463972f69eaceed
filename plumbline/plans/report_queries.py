"""Registered queries of an audit's report, sites, frames and certificates, and the same in
DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions.geometry import frame_twist
from plumbline.operators import audit, controls, directed, frame, graph, matching, repair, report, trials
from plumbline.operators.components import durable
from plumbline.operators.forest import spanning_forest
from plumbline.plans.audit_queries import _AXIS, ARCS, CFG, FOREST, LABELS, LINKS, MARGIN, NP, ORDER_PAIRS, PLANTED, _cut, _wrap, class_bounds, found_edges, found_links, kept_nodes, kept_sloped, links_in, points
from plumbline.sources.helix import POINTS_SQL, axis_table

TWIST = (0.2, 0.1, 0.05)


def corpus_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    return report.corpus_stats(p, frame.node_points(p, CFG.sense))


def coverage(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    return report.coverage(n, matching.edges(links_in(matching.in_cells(kept_sloped(spark, sf_dir, n), CFG)), CFG))


def axis_extrapolated(spark, sf_dir):
    """Places on the axis, its end segments carried on beyond its ends."""
    p = frame.place_on_axis(points(spark, sf_dir), axis_table(spark), clamp=False)
    return p.select("pid", F.round("axis_x", 6).alias("axis_x"), F.round("axis_y", 6).alias("axis_y"))


def audit_report(spark, sf_dir):
    """section, name, value: the counts of a whole audit."""
    n = kept_nodes(spark, sf_dir)
    sloped = kept_sloped(spark, sf_dir, n)
    c = matching.in_cells(sloped, CFG)
    centres = durable(matching.crowded_centres(c, CFG), "centres")
    found = durable(matching.links(c, CFG, centres), "links")
    edges = durable(matching.edges(found, CFG), "edges")
    parts = [
        ("matching", matching.match_stats(c, centres, found, CFG)),
        ("order", audit.order_audit(sloped, CFG).agg(*[F.sum(k).alias(k) for k in ("n_pairs", "n_sign", "n_split")])),
        ("conflicts", matching.conflicts(found, CFG).agg(F.count(F.lit(1)).alias("n_conflicts"))),
        ("coverage", report.coverage(n, edges).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_linked").alias("n_linked"))),
    ]
    rows = [p.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("value")) for k in p.columns]))) for section, p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def boundary_sites(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    found = durable(links_in(matching.in_cells(kept_sloped(spark, sf_dir, n), CFG)), "links")
    return report.boundary_sites(n, found, matching.edges(found, CFG), CFG.min_edge_support)


def link_band_census(spark, sf_dir):
    found = durable(found_links(spark, sf_dir), "links")
    return report.band_census(found, matching.edges(found, CFG), CFG.wrap_spacing_median, CFG.min_edge_support)


def cut_exposure(spark, sf_dir):
    """Of the angular gaps between the points that links join."""
    theta = points(spark, sf_dir).select("pid", "theta")
    side = lambda s: theta.select(F.col("pid").alias("pid_" + s), F.col("theta").alias("theta_" + s))
    g = found_links(spark, sf_dir).select("pid_a", "pid_b").join(side("a"), "pid_a").join(side("b"), "pid_b")
    e = report.cut_exposure(g, "theta_a", "theta_b")
    return e.select("n_gaps", *[F.round(c, 6).alias(c) for c in ("mean_width", "max_width", "expected", "probability")])


def _turned(spark, sf_dir):
    """The nodes in a twisted frame."""
    p = points(spark, sf_dir)
    theta = F.pmod(F.col("theta") + frame_twist(F.col("theta"), F.col("r"), F.col("z"), *TWIST), F.lit(2 * math.pi))
    return frame.node_points(p.withColumn("theta", theta), CFG.sense)


def frame_invariance(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    found = links_in(matching.in_cells(kept_sloped(spark, sf_dir, n), CFG))
    return report.gauge_differences(found, n, _turned(spark, sf_dir), CFG.sense)


def _cycles(spark, sf_dir):
    found = durable(found_links(spark, sf_dir), "links")
    edges = durable(matching.edges(found, CFG), "edges")
    forest = spanning_forest(edges, graph.free_nodes(edges))
    return found, edges, forest, durable(graph.fundamental_cycles(edges, forest=forest), "cycles")


def holonomy_signature(spark, sf_dir):
    """Each cycle that doesn't close, with what is left over."""
    return _cycles(spark, sf_dir)[3].where("holonomy <> 0").select("akey", "bkey", "holonomy")


def cycle_certificates(spark, sf_dir):
    _, edges, forest, cycles = _cycles(spark, sf_dir)
    return report.cycle_certificates(cycles, edges, forest)


def cycle_witnesses(spark, sf_dir):
    found, _, _, cycles = _cycles(spark, sf_dir)
    return report.cycle_witnesses(cycles, found).withColumn("gap", F.round("gap", 6))


def implicated_nodes(spark, sf_dir):
    found = durable(found_links(spark, sf_dir), "links")
    chosen = repair.quarantine(matching.edges(found, CFG)).where("chosen").select("nkey")
    return report.implicated_nodes(matching.conflicts(found, CFG), chosen)


def order_negative_cycles(spark, sf_dir):
    return class_bounds(spark, sf_dir).negative_cycles()


def order_sites(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    c = matching.in_cells(kept_sloped(spark, sf_dir, n), CFG)
    pairs, found = durable(matching.candidate_pairs(c, CFG, None), "candidates"), durable(links_in(c), "links")
    evidence = directed.order_evidence(pairs, found, CFG.wrap_spacing_median, MARGIN, CFG.min_edge_support)
    arcs = graph.order_arcs(pairs, found, CFG.wrap_spacing_median, MARGIN, CFG.min_edge_support)
    return directed.order_sites(n, arcs, evidence, CFG.min_edge_support)


def planted_summary(spark, sf_dir):
    s = controls.planted_summary(controls.planted_order_audit(controls.plant_steps(kept_nodes(spark, sf_dir), (0, 1, -1)), CFG))
    return s.select("scenario", "n_trials", "n_alarms", F.round("alarm_rate", 6).alias("alarm_rate"), F.round("mean_new", 6).alias("mean_new"))


def null_summary(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    base = audit.order_audit(audit.with_slopes(n, CFG.sense), CFG).agg(F.coalesce(F.sum(F.col("n_sign") + F.col("n_split")), F.lit(0))).first()[0]
    return controls.null_summary(controls.noise_null(n, CFG, rounds=5), base)


def _trials(spark, sf_dir):
    """Sites of the whole corpus and the results of all trials at them."""
    n = kept_nodes(spark, sf_dir)
    sloped = kept_sloped(spark, sf_dir, n)
    found = durable(links_in(matching.in_cells(sloped, CFG)), "links")
    sites = durable(report.boundary_sites(n, found, matching.edges(found, CFG), CFG.min_edge_support), "sites")
    return sites, trials.planted_trials(n, sloped, trials.trials_of(sites), CFG)


def planted_trials(spark, sf_dir):
    return _trials(spark, sf_dir)[1]


def planted_trial_summary(spark, sf_dir):
    sites, results = _trials(spark, sf_dir)
    s = trials.trial_summary(durable(results, "results"), sites)
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


def noise_alarms(spark, sf_dir):
    """Nodes that noise newly implicates, over five rounds."""
    return trials.noise_alarms(points(spark, sf_dir), CFG, rounds=5)


def noise_alarm_summary(spark, sf_dir):
    s = trials.alarm_summary(noise_alarms(spark, sf_dir), 5)
    return s.select("n_rounds", "n_alarms", *[F.round(c, 6).alias(c) for c in ("share", "low", "high", "mean_new")])


_TURNED = "theta + 2e-1 * sin(z / 7e2 + 3e-1) + 1e-1 * cos(r / 1.5e2) + 5e-2 * sin(theta)"

QUERIES = {
    "corpus_stats": (
        corpus_stats,
        f"""{NP}, pk AS (SELECT kind, count(DISTINCT cid) AS n_collections, count(*) AS n_points FROM points GROUP BY kind),
nn AS (SELECT kind, nkey, max(crossings <> 0) AS x, min(seam_safe) AS s FROM np GROUP BY kind, nkey)
SELECT pk.*, n_nodes, n_crossing, n_seam_unsafe FROM pk JOIN (SELECT kind, count(*) AS n_nodes, count(*) FILTER (x) AS n_crossing, count(*) FILTER (NOT s) AS n_seam_unsafe FROM nn GROUP BY kind) USING (kind)""",
    ),
    "coverage": (
        coverage,
        f"""{LINKS}, en AS (SELECT akey AS k FROM ed UNION SELECT bkey FROM ed)
SELECT kind, count(DISTINCT nkey) AS n_nodes, count(DISTINCT k) AS n_linked FROM np LEFT JOIN en ON k = nkey GROUP BY kind""",
    ),
    "axis_extrapolated": (
        axis_extrapolated,
        f"""WITH {POINTS_SQL}, ax(z0, x0, y0) AS (VALUES {_AXIS}),
seg AS (SELECT *, lead(z0) OVER w AS z1, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, lag(z0) OVER w IS NULL AS f, row_number() OVER (ORDER BY z0 DESC) = 2 AS l FROM ax WINDOW w AS (ORDER BY z0))
SELECT pid, round(x0 + (z - z0) / (z1 - z0) * (x1 - x0), 6) AS axis_x, round(y0 + (z - z0) / (z1 - z0) * (y1 - y0), 6) AS axis_y
FROM points JOIN seg ON z1 IS NOT NULL AND (z >= z0 OR f) AND (z < z1 OR l)""",
    ),
    "audit_report": (
        audit_report,
        f"""{LINKS}, op AS (SELECT a.label - b.label + {_cut("a.theta", "b.theta")} AS d, CASE WHEN a.slope IS NULL AND b.slope IS NULL THEN CASE WHEN abs(b.z - a.z) <= 10 THEN a.r - b.r END
  WHEN a.slope IS NULL THEN a.r - (b.r + b.slope * (a.z - b.z)) WHEN b.slope IS NULL THEN (a.r + a.slope * (b.z - a.z)) - b.r
  ELSE (a.r + a.slope * (5e-1 * (a.z + b.z) - a.z)) - (b.r + b.slope * (5e-1 * (a.z + b.z) - b.z)) END AS gap
  FROM pc a JOIN pc b ON a.nkey = b.nkey AND a.pid < b.pid AND a.kind <> 'same' AND abs(a.z - b.z) <= 10 AND abs({_wrap("a.theta - b.theta")}) <= 6.981317007977318e-2),
en AS (SELECT akey AS k FROM ed UNION SELECT bkey FROM ed)
SELECT 'matching' AS section, 'n_points' AS name, (SELECT count(*) FROM pc) AS value UNION ALL SELECT 'matching', 'n_points_with_slope', (SELECT count(slope) FROM pc)
UNION ALL SELECT 'matching', 'n_cells', (SELECT count(*) FROM veto) UNION ALL SELECT 'matching', 'n_vetoed_cells', (SELECT count(*) FROM veto WHERE vetoed)
UNION ALL SELECT 'matching', 'n_links', (SELECT count(*) FROM lk) UNION ALL SELECT 'matching', 'n_cut_links', (SELECT count(*) FROM lk WHERE over_cut)
UNION ALL SELECT 'matching', 'n_unsupported_links', (SELECT CAST(coalesce(sum(support), 0) AS BIGINT) FROM sup WHERE support < 2) UNION ALL SELECT 'matching', 'n_edges', (SELECT count(*) FROM ed)
UNION ALL SELECT 'order', 'n_pairs', (SELECT count(*) FROM op WHERE gap IS NOT NULL) UNION ALL SELECT 'order', 'n_sign', (SELECT count(*) FROM op WHERE d <> 0 AND d * gap < 0 AND abs(gap) > 7)
UNION ALL SELECT 'order', 'n_split', (SELECT count(*) FROM op WHERE d = 0 AND abs(gap) > 14)
UNION ALL SELECT 'conflicts', 'n_conflicts', (SELECT count(*) FROM (SELECT DISTINCT akey, bkey FROM sup2 WHERE support >= 2 AND k > 1))
UNION ALL SELECT 'coverage', 'n_nodes', (SELECT count(DISTINCT nkey) FROM np) UNION ALL SELECT 'coverage', 'n_linked', (SELECT count(*) FROM en)""",
    ),
    "boundary_sites": (
        boundary_sites,
        f"""{LABELS}, ch AS (SELECT nkey, kind, pid, row_number() OVER (PARTITION BY nkey ORDER BY pid) AS i, count(*) OVER (PARTITION BY nkey) AS n FROM np WHERE kind <> 'absolute'),
bd AS (SELECT nkey, kind, CAST(unnest(generate_series(1, n - 1)) AS INT) AS b FROM (SELECT DISTINCT nkey, kind, n FROM ch WHERE n >= 4)),
en AS (SELECT akey AS k, bkey AS p, pid_a AS pid FROM lk UNION ALL SELECT bkey, akey, pid_b FROM lk),
sd AS (SELECT bd.nkey, bd.b, en.p, count(*) FILTER (ch.i <= b) AS l, count(*) FILTER (ch.i > b) AS r FROM bd JOIN en ON en.k = bd.nkey JOIN ch ON ch.nkey = bd.nkey AND ch.pid = en.pid GROUP BY ALL),
rk(k, x, y) AS (SELECT DISTINCT k, p, p FROM en WHERE k NOT LIKE 'absolute:%' UNION SELECT rk.k, rk.x, bo.y FROM rk JOIN bo ON bo.x = rk.y AND bo.y <> rk.k),
lb AS (SELECT DISTINCT k, x FROM rk WHERE y NOT LIKE 'same:%' AND y IN (SELECT x FROM bo)),
ok AS (SELECT DISTINCT s.nkey, s.b FROM sd s JOIN rk ON rk.k = s.nkey AND rk.x = s.p JOIN sd t ON t.nkey = s.nkey AND t.b = s.b AND t.p = rk.y
  WHERE s.l >= 2 AND t.r >= 2 AND (s.nkey LIKE 'relative:%' OR EXISTS (SELECT 1 FROM lb WHERE lb.k = s.nkey AND lb.x = s.p)))
SELECT bd.nkey, bd.b AS boundary, count(*) FILTER (sd.l >= 2) AS n_left, count(*) FILTER (sd.r >= 2) AS n_right, max(ok.b IS NOT NULL) AS reachable
FROM bd LEFT JOIN sd USING (nkey, b) LEFT JOIN ok USING (nkey, b) GROUP BY bd.nkey, bd.b""",
    ),
    "link_band_census": (
        link_band_census,
        f"""{LINKS}, pr AS (SELECT akey, bkey, off, count(*) AS n, count(*) FILTER (abs(gap) <= 5) AS m FROM lk GROUP BY ALL),
pe AS (SELECT pr.*, ed.akey IS NOT NULL AS e, count(*) FILTER (m >= 2) OVER (PARTITION BY pr.akey, pr.bkey) AS k FROM pr LEFT JOIN ed ON ed.akey = pr.akey AND ed.bkey = pr.bkey AND ed."offset" = pr.off)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_links, CAST(coalesce(sum(n - m), 0) AS BIGINT) AS n_band_links, count(*) FILTER (e AND n > m) AS n_band_edges, count(*) FILTER (e AND m = 0) AS n_only_band_edges,
  count(*) FILTER (m >= 2 AND k = 1) AS n_tight_edges FROM pe""",
    ),
    "cut_exposure": (
        cut_exposure,
        f"""{LINKS}, g AS (SELECT abs({_wrap("a.theta - b.theta")}) AS w FROM lk JOIN points a ON a.pid = pid_a JOIN points b ON b.pid = pid_b)
SELECT count(*) AS n_gaps, round(avg(w), 6) AS mean_width, round(max(w), 6) AS max_width, round(coalesce(sum(w), 0) / (2 * pi()), 6) AS expected, round(1 - exp(-coalesce(sum(w), 0) / (2 * pi())), 6) AS probability FROM g""",
    ),
    "frame_invariance": (
        frame_invariance,
        f"""{LINKS}, t0 AS (SELECT pid, kind, cid, wind_a, ({_TURNED}) - 2 * pi() * floor(({_TURNED}) / (2 * pi())) AS th FROM points),
t1 AS (SELECT *, coalesce({_cut("lag(th) OVER w", "th")}, 0) AS c FROM t0 WHERE kind <> 'absolute' WINDOW w AS (PARTITION BY kind, cid ORDER BY pid)),
t2 AS (SELECT pid, th, CAST(CASE WHEN kind = 'relative' THEN wind_a ELSE 0 END AS BIGINT) + sum(c) OVER (PARTITION BY kind, cid ORDER BY pid) AS lt FROM t1 UNION ALL SELECT pid, th, CAST(wind_a AS BIGINT) FROM t0 WHERE kind = 'absolute'),
mv AS (SELECT np.nkey, np.pid, th, lt, first_value({_cut("theta", "th")}) OVER (PARTITION BY nkey ORDER BY np.pid) AS g FROM np JOIN t2 ON t2.pid = np.pid),
dd AS (SELECT lk.a, lk.b, x.lt - y.lt + {_cut("x.th", "y.th")} - off AS d, y.g - x.g AS e FROM lk JOIN mv x ON x.nkey = akey AND x.pid = pid_a JOIN mv y ON y.nkey = bkey AND y.pid = pid_b)
SELECT a, b, count(*) AS n_links, count(*) FILTER (d <> 0) AS n_changed, count(*) FILTER (d <> e) AS n_off FROM dd GROUP BY a, b""",
    ),
    "holonomy_signature": (holonomy_signature, f"{FOREST} SELECT akey, bkey, holonomy FROM cy WHERE holonomy <> 0"),
    "cycle_certificates": (
        cycle_certificates,
        f"""{FOREST}, bc AS (SELECT * FROM cy WHERE holonomy <> 0)
SELECT akey, bkey, 0 AS seq, akey AS from_key, bkey AS to_key, CAST("offset" AS BIGINT) AS contribution FROM bc JOIN ed USING (akey, bkey)
UNION ALL SELECT akey, bkey, CAST(path_nodes - 1 - seq AS INT), t, f, -o FROM bc JOIN st USING (akey, bkey)""",
    ),
    "cycle_witnesses": (cycle_witnesses, f'{FOREST} SELECT akey, bkey, pid_a, pid_b, off AS "offset", round(gap, 6) AS gap FROM lk JOIN cy USING (akey, bkey) WHERE holonomy <> 0'),
    "implicated_nodes": (implicated_nodes, None),
    "order_negative_cycles": (order_negative_cycles, None),
    "order_sites": (
        order_sites,
        f"""{ARCS.replace("WITH", "WITH RECURSIVE", 1)},
evd AS (SELECT a AS u, b AS v, pid_a AS pu, pid_b AS pv FROM lk JOIN sup USING (akey, bkey, off, a, b) WHERE support >= 2 UNION ALL SELECT b, a, pid_b, pid_a FROM lk JOIN sup USING (akey, bkey, off, a, b) WHERE support >= 2
  UNION ALL SELECT u, v, pu, pv FROM (SELECT CASE WHEN gap > 0 THEN a ELSE b END AS u, CASE WHEN gap > 0 THEN b ELSE a END AS v, CASE WHEN gap > 0 THEN pid_a ELSE pid_b END AS pu, CASE WHEN gap > 0 THEN pid_b ELSE pid_a END AS pv,
    count(*) OVER (PARTITION BY CASE WHEN gap > 0 THEN a ELSE b END, CASE WHEN gap > 0 THEN b ELSE a END, CASE WHEN gap > 0 THEN off - 1 ELSE -off - 1 END) AS n FROM cand WHERE abs(gap) > 20) WHERE n >= 2),
ch AS (SELECT node, pid, row_number() OVER (PARTITION BY node ORDER BY pid) AS i, count(*) OVER (PARTITION BY node) AS n FROM np WHERE kind <> 'absolute'),
side AS (SELECT u AS node, v AS p, pu AS pid, 1 AS o FROM evd UNION ALL SELECT v, u, pv, 0 FROM evd),
bd AS (SELECT node, CAST(unnest(generate_series(1, n - 1)) AS INT) AS b FROM (SELECT DISTINCT node, n FROM ch WHERE n >= 4)),
sd AS MATERIALIZED (SELECT bd.node, b, p, o, count(*) FILTER (i <= b) AS l, count(*) FILTER (i > b) AS r FROM bd JOIN ch ON ch.node = bd.node JOIN side ON side.node = ch.node AND side.pid = ch.pid GROUP BY ALL),
ar AS MATERIALIZED (SELECT DISTINCT u, v FROM arcs),
rk(k, x, y) AS (SELECT DISTINCT node, p, p FROM sd WHERE o = 1 AND (l >= 2 OR r >= 2) UNION SELECT k, x, v FROM rk JOIN ar ON u = y AND v <> k),
ok AS (SELECT DISTINCT s.node, s.b FROM sd s JOIN rk ON rk.k = s.node AND rk.x = s.p JOIN sd t ON t.node = s.node AND t.b = s.b AND t.p = rk.y AND t.o = 0
  WHERE s.o = 1 AND (s.l >= 2 AND t.r >= 2 OR s.r >= 2 AND t.l >= 2))
SELECT bd.node, bd.b AS boundary, ok.b IS NOT NULL AS covered FROM bd LEFT JOIN ok USING (node, b)""",
    ),
    "planted_summary": (
        planted_summary,
        "SELECT scenario, count(*) AS n_trials, count(*) FILTER (m > 0) AS n_alarms, round(avg(CAST(m > 0 AS INT)), 6) AS alarm_rate, round(avg(m) FILTER (m > 0), 6) AS mean_new FROM"
        " (SELECT CAST(split_part(node, '#', 1) AS INT) AS scenario, n_sign + n_split - max(CASE WHEN node LIKE '0#%' THEN n_sign + n_split END) OVER (PARTITION BY split_part(node, '#', 2)) AS m FROM ("
        + PLANTED.replace("VALUES (1), (-1)", "VALUES (0), (1), (-1)").format(kind="kind = 'relative'", r="r", label="label + CASE WHEN i > n // 2 THEN d ELSE 0 END")
        + ORDER_PAIRS
        + ")) WHERE scenario <> 0 GROUP BY scenario",
    ),
    "null_summary": (null_summary, None),
    "planted_trials": (planted_trials, None),
    "planted_trial_summary": (planted_trial_summary, None),
    "noise_alarms": (noise_alarms, None),
    "noise_alarm_summary": (noise_alarm_summary, None),
}
