"""Queries over overlap graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seq import revcomp
from ..operators import dag as D
from ..operators import graph as G
from ..operators import scoring as C
from ..session import table
from . import inputs
from .score_plans import _ranks


def _best(spark, sf_dir):
    """Best edge of every oriented pair, with the shift of the right read."""
    e = C.best_edges(inputs.edges(spark, sf_dir), "paf_line")
    n = inputs.reads(spark, sf_dir).select(F.col("rid").alias("left_id"), F.length("seq").cast("bigint").alias("n"))
    return e.join(n, "left_id").withColumn("shift", F.col("n") - F.col("overlap_len"))


def _evidence(spark, sf_dir):
    return table(spark, sf_dir, "containment").drop("loaded_at").distinct()


def weak_component_labels(spark, sf_dir):
    return G.weak_components(_best(spark, sf_dir))


def scc_labels(spark, sf_dir):
    return G.strong_components(_best(spark, sf_dir))


def largest_scc(spark, sf_dir):
    return G.largest_component(G.strong_components(_best(spark, sf_dir)), F.regexp_replace("node", "[+-]$", ""))


def orientation_constraints(spark, sf_dir):
    return G.orientation_constraints(inputs.edges(spark, sf_dir)).select("first", "second", "parity", "paf_line")


def orientation(spark, sf_dir):
    return G.select_orientation(inputs.edges(spark, sf_dir), inputs.reads(spark, sf_dir))[0]


def orientation_report(spark, sf_dir):
    """Constraints, trees and reads, and whether the kept edges are those that agree with the orientations told."""
    e, r = inputs.edges(spark, sf_dir), inputs.reads(spark, sf_dir)
    o, kept, report = G.select_orientation(e, r)
    f = lambda x: o.select(F.col("rid").alias(f"{x}_id"), F.col("orientation").alias(f"_{x}"))
    agree = e.join(f("left"), "left_id").join(f("right"), "right_id").where("_left = left_orientation and _right = right_orientation").agg(F.count(F.lit(1)).alias("agree"))
    return report.crossJoin(agree).select("constraints", "components", "reads", (F.col("agree") == F.col("edges")).alias("consistent"))  # one row each


def contained_reads(spark, sf_dir):
    return G.contained_reads(inputs.reads(spark, sf_dir), _evidence(spark, sf_dir))


def full_cov_groups(spark, sf_dir):
    from .paf_plans import full_coverage_pairs

    return G.covered_reads(inputs.reads(spark, sf_dir), inputs.edges(spark, sf_dir), full_coverage_pairs(spark, sf_dir))


def low_support(spark, sf_dir):
    return G.unsupported_reads(inputs.reads(spark, sf_dir), inputs.edges(spark, sf_dir), 2, 2)


def clean_graph(spark, sf_dir):
    """Edges left when contained and then unsupported reads are removed."""
    r, e = inputs.reads(spark, sf_dir), inputs.edges(spark, sf_dir)
    r, e = G.without_reads(r, e, contained_reads(spark, sf_dir))
    r, e = G.without_reads(r, e, G.unsupported_reads(r, e, 2, 2))
    return e.select("source", "target", "paf_line")


def degree_stats(spark, sf_dir):
    d = G.degree_table(inputs.edges(spark, sf_dir))
    parts = [d.agg(F.lit(c).alias("side"), F.min(c).alias("least"), F.round(F.avg(c), 9).alias("mean"), F.median(c).alias("median"), F.max(c).alias("most")) for c in ("out_degree", "in_degree")]
    return parts[0].unionByName(parts[1])


def transitive_reduction(spark, sf_dir):
    """Edges that no two others explain."""
    e = _best(spark, sf_dir).select("source", "target", "shift")
    return e.join(G.transitive_edges(e, 40).select("source", "target"), ["source", "target"], "left_anti")


def parallel_edges(spark, sf_dir):
    """Best of the parallel alignments of an oriented pair, with the number of others."""
    e = inputs.edges(spark, sf_dir)
    g = e.groupBy("source", "target").agg(F.max(F.struct("overlap_len", "identity", "matches", (-F.col("paf_line")).alias("p"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("source", "target", "b.overlap_len", "b.identity", (-F.col("b.p")).alias("paf_line"), (F.col("n") - 1).alias("others"))


def parallel_ports(spark, sf_dir):
    """Best parallel edge by identity, overlap, coverage and cost."""
    e = _best_candidates = inputs.edges(spark, sf_dir).withColumns({"coverage": F.lit(1.0), "cost": F.col("block")})
    g = e.groupBy("source", "target").agg(F.max_by("paf_line", F.struct(F.round(C.port_score(), 6).alias("s"), (-F.col("paf_line")).alias("p"))).alias("paf_line"))
    return g


def quality_filter(spark, sf_dir):
    """Edges that are long, alike and run from end to beginning."""
    return inputs.edges(spark, sf_dir).where("overlap_len >= 100 and identity >= 0.985 and block - overlap_len <= 2").select("source", "target", "paf_line")


def overlap_classes(spark, sf_dir):
    """Kind of every alignment: too short or unlike, unknown, strictly contained either way, dovetail, internal."""
    p = inputs.paf_fields(spark, sf_dir)
    known = F.col("q_len").isNotNull() & F.col("t_len").isNotNull()
    near = lambda s, e, n: ((F.col(s) <= 5), (F.col(n) - F.col(e) <= 5))
    (q0, q1), (t0, t1) = near("q_st", "q_en", "q_len"), near("t_st", "t_en", "t_len")
    short = (F.col("block") < 60) | ((F.col("block") > 0) & (F.col("n_match") / F.col("block") < 0.98))
    kind = F.when(short, "TOO_SHORT").when(~known, "UNKNOWN").when(q0 & q1 & (F.col("q_len") < F.col("t_len")), "Q_CONTAINED").when(t0 & t1 & (F.col("t_len") < F.col("q_len")), "T_CONTAINED")
    return p.select("line_no", kind.when((q0 | q1) & (t0 | t1), "DOVETAIL").otherwise("INTERNAL").alias("kind"))


def strongest_incident(spark, sf_dir):
    """The strongest edge out of and into every node, each once."""
    e = inputs.edges(spark, sf_dir)
    s = F.struct("weight_dp", "overlap_len", (-F.col("paf_line")).alias("p"))
    parts = [e.where("weight_dp is not null").groupBy(side).agg(F.max_by(F.struct("source", "target", "paf_line"), s).alias("b")).select("b.*") for side in ("source", "target")]
    return parts[0].unionByName(parts[1]).distinct()


def best_outgoing(spark, sf_dir):
    """Longest alignment of each left read."""
    e = inputs.edges(spark, sf_dir)
    return e.groupBy("left_id").agg(F.max_by(F.struct("right_id", "overlap_len"), F.struct("overlap_len", (-F.col("paf_line")).alias("p"))).alias("b")).select("left_id", "b.right_id", "b.overlap_len")


def top_edges(spark, sf_dir):
    """The hundred longest edges."""
    return inputs.edges(spark, sf_dir).orderBy(F.desc("overlap_len"), F.desc("identity"), "paf_line", "source", "target").limit(100).select("source", "target", "overlap_len", "paf_line")


def forced_unitig_edges(spark, sf_dir):
    return G.forced_edges(_best(spark, sf_dir))


def unitig_chains(spark, sf_dir):
    return G.unitigs(_best(spark, sf_dir))


def unitig_contraction(spark, sf_dir):
    e = _best(spark, sf_dir)
    return G.contract_unitigs(e, G.unitigs(e))


def safe_unitigs(spark, sf_dir):
    """Chains without a cycle, and what each node of the graph is mapped to."""
    e = _best(spark, sf_dir)
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return G.map_nodes(n, G.safe_unitigs(e, G.unitigs(e)))


def region_checks(spark, sf_dir):
    """Per region: whether it cuts no chain, and whether all its nodes lie on ways from an entry to an exit within it."""
    e, m = _best(spark, sf_dir), _regions(spark, sf_dir)
    u = G.unitigs(e)
    at = lambda x: u.select(F.col("node").alias(x), F.col("head").alias(f"h{x[0]}"), F.col("position").alias(f"p{x[0]}"))
    blocks = e.select("source", "target").distinct().join(at("source"), "source").join(at("target"), "target").where("hs = ht and pt = ps + 1").select(F.col("hs").alias("block"), "source", "target")
    cut = G.broken_regions(m, blocks).withColumn("c", F.lit(True))
    fine = G.supported_regions(e, m).withColumn("s", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return m.select("region").distinct().join(cut, "region", "left").join(fine, "region", "left").select("region", (~no("c")).alias("atomic"), no("s").alias("supported"))


def _node_table(spark, sf_dir):
    e = _best(spark, sf_dir)
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    r = inputs.reads(spark, sf_dir).select("rid", F.length("seq").cast("bigint").alias("length"), "seq")
    return n.join(r, F.regexp_replace("node", "[+-]$", "") == F.col("rid")).select("node", "length", (F.col("length") % 7).cast("double").alias("coverage"), "seq")


def tips_removed(spark, sf_dir):
    return G.remove_tips(_best(spark, sf_dir), _node_table(spark, sf_dir).drop("seq"), 600, 3.0).select("node")


def bubbles(spark, sf_dir):
    e = _best(spark, sf_dir)
    seq = F.when(F.endswith("node", F.lit("+")), F.col("seq")).otherwise(revcomp("seq"))
    return G.equal_bubbles(e, _node_table(spark, sf_dir).withColumn("seq", seq), G.unitigs(e))


def cycle_components(spark, sf_dir):
    e = _best(spark, sf_dir)
    c = G.simple_cycles(e, G.strong_components(e))
    mid = F.element_at("cycle", F.floor(F.size("cycle") / 2).cast("int") + 1)
    return c.select("component", "nodes", F.array_join("cycle", ",").alias("cycle"), F.array_join(G.split_cycle(F.col("cycle"), mid, F.col("component")), ",").alias("part"))


def scc_contraction(spark, sf_dir):
    e = _best(spark, sf_dir)
    return G.contract_components(e.select("source", "target"), G.strong_components(e))


def repeat_blocks(spark, sf_dir):
    return G.repeat_blocks(_best(spark, sf_dir), 6)


def _regions(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").where("contig is not null and node is not null").select(F.col("contig").alias("region"), "node").distinct()
    only = n.groupBy("node").agg(F.min("region").alias("region"))
    return only.select("region", "node")


def boundary_edges(spark, sf_dir):
    return G.boundary_edges(_best(spark, sf_dir), _regions(spark, sf_dir))


def region_compression(spark, sf_dir):
    """Per region: the macro edges it would be replaced by, and its different entries and exits."""
    return G.macro_counts(_best(spark, sf_dir), _regions(spark, sf_dir))


def region_closure(spark, sf_dir):
    """Regions grown until no path leaves and comes back."""
    c = G.close_regions(_best(spark, sf_dir), _regions(spark, sf_dir))
    return c.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"))


def _forward(spark, sf_dir):
    """Edges from a read to one that starts later: acyclic."""
    k = _ranks(spark, sf_dir).select("rid", "rank")
    e = inputs.edges(spark, sf_dir).select("left_id", "right_id").distinct()
    e = e.join(k.select(F.col("rid").alias("left_id"), F.col("rank").alias("a")), "left_id").join(k.select(F.col("rid").alias("right_id"), F.col("rank").alias("b")), "right_id").where("a < b")
    return e.select(F.col("left_id").alias("source"), F.col("right_id").alias("target"))


def path_levels(spark, sf_dir):
    return D.path_levels(_forward(spark, sf_dir))


def longest_path_dag(spark, sf_dir):
    return D.longest_path(_forward(spark, sf_dir))


def _contig_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").where("contig is not null and node is not null and start >= 0").groupBy("contig", "node").agg(F.min("start").alias("start"))
    e = inputs.edges(spark, sf_dir).select("source", "target").distinct()
    s, t = n.select("contig", F.col("node").alias("source"), F.col("start").alias("a")), n.select("contig", F.col("node").alias("target"), F.col("start").alias("b"))
    return e.join(s, "source").join(t, ["contig", "target"]).select(F.col("contig").alias("entity"), "source", "target", (F.col("b") - F.col("a")).alias("shift"), "a", "b")


def cut_crossings(spark, sf_dir):
    """Edges that reach over each cut of a contig."""
    e = _contig_edges(spark, sf_dir)
    return D.cut_crossings(e.where("a <> b").select("entity", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "entity").withColumnRenamed("entity", "contig")


def _layout(spark, sf_dir):
    e = _contig_edges(spark, sf_dir).withColumn("shift", F.abs("shift") + 1)
    anchors = e.groupBy("entity").agg(F.min("source").alias("node"))
    return e, anchors, D.shift_layout(e, anchors)


def circular_layout(spark, sf_dir):
    return _layout(spark, sf_dir)[2]


def rebased_layout(spark, sf_dir):
    """The layout of each contig counted from where fewest edges run."""
    e, anchors, p = _layout(spark, sf_dir)
    return D.rebase_layout(e, p, D.circumference(e, p, anchors))


def region_tiers(spark, sf_dir):
    """Size of the macro-edge model of each region, and its tier."""
    d = G.region_tiers(_best(spark, sf_dir), _regions(spark, sf_dir), 40, 200)
    return d.select("region", "variables", "couplings", F.round("degree", 9).alias("degree"), "tier")


def layout_residuals(spark, sf_dir):
    e, anchors, p = _layout(spark, sf_dir)
    return D.residuals(e, p, D.circumference(e, p, anchors))


def circular_windows(spark, sf_dir):
    return D.circular_windows(_layout(spark, sf_dir)[2], 8).select("entity", "node", "window")


def window_graphs(spark, sf_dir):
    e, _, p = _layout(spark, sf_dir)
    return D.window_graph(e, D.circular_windows(p, 8))


def macro_expansion(spark, sf_dir):
    """Chains of the graph as macro edges, chains of chains above them, expanded to their nodes again."""
    u = G.unitigs(_best(spark, sf_dir))
    low = u.select(F.concat(F.lit("c:"), "head").alias("macro"), F.col("position").alias("seq"), F.col("node").alias("child"))
    high = u.select("head").distinct().select(F.concat(F.lit("t:"), F.substring("head", 1, 3)).alias("macro"), F.xxhash64("head").alias("seq"), F.concat(F.lit("c:"), "head").alias("child"))
    c = low.unionByName(high)
    d = D.expand_macros(c, high.select(F.col("macro").alias("root")).distinct())
    return d.groupBy("root").agg(F.count(F.lit(1)).alias("leaves"), F.count_distinct("leaf").alias("nodes"))


_FUNCTIONS = (
    weak_component_labels, scc_labels, largest_scc, orientation_constraints, orientation, orientation_report, contained_reads, full_cov_groups, low_support, clean_graph, degree_stats, transitive_reduction,
    parallel_edges, parallel_ports, quality_filter, overlap_classes, strongest_incident, best_outgoing, top_edges, forced_unitig_edges, unitig_chains, unitig_contraction, safe_unitigs, region_checks, tips_removed, bubbles, cycle_components, scc_contraction,
    repeat_blocks, boundary_edges, region_compression, region_closure, path_levels, longest_path_dag, cut_crossings, circular_layout, rebased_layout, region_tiers, layout_residuals, circular_windows, window_graphs, macro_expansion,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_E, _RE = "WITH RECURSIVE " + inputs.EDGES, "WITH RECURSIVE " + inputs.READS + "," + inputs.EDGES
_GRAPH = _RE + """,
    og AS (SELECT e.*, length(seq) - overlap_len AS shift FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY coalesce(weight_dp, dp_score) DESC NULLS LAST, paf_line) AS k0 FROM e) e JOIN r ON rid = left_id WHERE k0 = 1),
    g AS (SELECT source, target, shift, paf_line FROM og)"""
_WEAK = """,
    u AS (SELECT source AS a, target AS b FROM {0} UNION SELECT target, source FROM {0}),
    low(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM u GROUP BY a
        UNION SELECT u.a, min(low.component) FROM low JOIN u ON u.b = low.node JOIN recurring.low AS cur ON cur.node = u.a WHERE low.component < cur.component GROUP BY u.a)"""
_STRONG = """,
    reach(a, b) AS (SELECT source, target FROM g UNION SELECT a, target FROM reach JOIN g ON b = source),
    both AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a),
    sn AS (SELECT source AS node FROM g UNION SELECT target FROM g),
    scc AS (SELECT node, least(node, coalesce(min(b), node)) AS component FROM sn LEFT JOIN both_way ON a = node GROUP BY node)""".replace("both AS", "both_way AS")
_REMOVED = """,
    ev AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM containment),
    gone AS (SELECT contained_id AS rid, 'contained_in:' || container_id AS reason FROM (SELECT v.*, row_number() OVER (PARTITION BY contained_id ORDER BY coalesce(identity, -1) DESC, alignment_length DESC NULLS LAST, length(b.seq) DESC, container_id DESC) AS k
        FROM ev v JOIN r a ON a.rid = contained_id JOIN r b ON b.rid = container_id WHERE length(a.seq) < length(b.seq)) WHERE k = 1)"""
_SUPPORT = """ SELECT rid, CASE WHEN i < 2 AND o < 2 THEN 'low_quality:no_in_or_out_support' WHEN i < 2 THEN 'low_quality:no_in_support' ELSE 'low_quality:no_out_support' END AS reason FROM (
        SELECT r.rid, (SELECT count(DISTINCT (right_id, left_orientation, right_orientation)) FROM ek WHERE left_id = r.rid) AS o, (SELECT count(DISTINCT (left_id, left_orientation, right_orientation)) FROM ek WHERE right_id = r.rid) AS i FROM {0} r) WHERE i < 2 OR o < 2"""
_FORCED = """,
    f AS (SELECT DISTINCT source, target FROM g WHERE source <> target AND source IN (SELECT source FROM g WHERE source <> target GROUP BY source HAVING count(DISTINCT target) = 1)
          AND target IN (SELECT target FROM g WHERE source <> target GROUP BY target HAVING count(DISTINCT source) = 1)),
    ch(node, head, position) AS (SELECT DISTINCT source, source, CAST(0 AS BIGINT) FROM f WHERE source NOT IN (SELECT target FROM f) UNION ALL SELECT f.target, head, position + 1 FROM ch JOIN f ON f.source = ch.node)"""
_REGION = """,
    m AS (SELECT node, min(contig) AS region FROM nodes WHERE contig IS NOT NULL AND node IS NOT NULL GROUP BY node),
    be AS (SELECT a.region AS rs, b.region AS rt, d.source, d.target FROM (SELECT DISTINCT source, target FROM g) d LEFT JOIN m a ON a.node = d.source LEFT JOIN m b ON b.node = d.target),
    bk AS (SELECT rs AS region, source, target, CASE WHEN rs = rt THEN 'internal' ELSE 'outgoing' END AS kind FROM be WHERE rs IS NOT NULL UNION ALL SELECT rt, source, target, 'incoming' FROM be WHERE rt IS NOT NULL AND (rs IS NULL OR rs <> rt))"""
_DAG = _RE + """,
    k AS (SELECT rid, row_number() OVER (ORDER BY true_start, rid) AS rank FROM r WHERE true_start >= 0 AND true_end > true_start),
    de AS (SELECT DISTINCT left_id AS source, right_id AS target FROM e JOIN k a ON a.rid = left_id JOIN k b ON b.rid = right_id WHERE a.rank < b.rank),
    lv(node, level) USING KEY (node) AS (SELECT DISTINCT n, CAST(0 AS BIGINT) FROM (SELECT source AS n FROM de UNION SELECT target FROM de)
        UNION SELECT de.target, max(lv.level + 1) FROM lv JOIN de ON de.source = lv.node JOIN recurring.lv AS cur ON cur.node = de.target WHERE lv.level + 1 > cur.level GROUP BY de.target)"""
_CONTIG = _E + """,
    cn AS (SELECT contig, node, min(start) AS start FROM nodes WHERE contig IS NOT NULL AND node IS NOT NULL AND start >= 0 GROUP BY ALL),
    ce AS (SELECT a.contig AS entity, d.source, d.target, b.start - a.start AS shift, a.start AS a, b.start AS b FROM (SELECT DISTINCT source, target FROM e) d JOIN cn a ON a.node = d.source JOIN cn b ON b.node = d.target AND b.contig = a.contig)"""

SQL = {
    "weak_component_labels": _GRAPH + _WEAK.replace("{0}", "g") + " SELECT node, component FROM low",
    "scc_labels": _GRAPH + _STRONG + " SELECT node, component FROM scc",
    "largest_scc": _GRAPH + _STRONG + """, sz AS (SELECT component, count(DISTINCT regexp_replace(node, '[+-]$', '')) AS reads, count(*) AS n FROM scc GROUP BY component HAVING count(*) > 1)
        SELECT node FROM scc WHERE component = (SELECT component FROM sz ORDER BY reads DESC, n DESC, component LIMIT 1)""",
    "orientation_constraints": _E + """ SELECT first, second, CAST(parity AS INT) AS parity, paf_line FROM (SELECT least(left_id, right_id) AS first, greatest(left_id, right_id) AS second, left_orientation * right_orientation AS parity, paf_line,
        row_number() OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id), left_orientation * right_orientation ORDER BY overlap_len DESC, identity DESC, error_rate DESC, paf_line) AS k FROM e) WHERE k = 1""",
    "contained_reads": _RE + _REMOVED + " SELECT rid, reason FROM gone",
    "low_support": _RE + ", ek AS (SELECT * FROM e WHERE left_id IN (SELECT rid FROM r) AND right_id IN (SELECT rid FROM r))" + _SUPPORT.replace("{0}", "r"),
    "clean_graph": _RE + _REMOVED + """, rk AS (SELECT * FROM r WHERE rid NOT IN (SELECT rid FROM gone)), e1 AS (SELECT * FROM e WHERE left_id NOT IN (SELECT rid FROM gone) AND right_id NOT IN (SELECT rid FROM gone)),
        ek AS (SELECT * FROM e1 WHERE left_id IN (SELECT rid FROM rk) AND right_id IN (SELECT rid FROM rk)), weak AS (""" + _SUPPORT.replace("{0}", "rk") + ") SELECT source, target, paf_line FROM e1 WHERE left_id NOT IN (SELECT rid FROM weak) AND right_id NOT IN (SELECT rid FROM weak)",
    "degree_stats": _E + """, d AS (SELECT coalesce(a.source, b.target) AS node, coalesce(a.n, 0) AS o, coalesce(b.n, 0) AS i FROM (SELECT source, count(DISTINCT target) AS n FROM e GROUP BY source) a FULL JOIN (SELECT target, count(DISTINCT source) AS n FROM e GROUP BY target) b ON a.source = b.target)
        SELECT 'out_degree' AS side, min(o) AS least, round(avg(o), 9) AS mean, median(o) AS median, max(o) AS most FROM d UNION ALL SELECT 'in_degree', min(i), round(avg(i), 9), median(i), max(i) FROM d""",
    "transitive_reduction": _GRAPH + " SELECT source, target, shift FROM g WHERE NOT EXISTS (SELECT 1 FROM g a JOIN g b ON a.target = b.source WHERE a.source = g.source AND b.target = g.target AND a.source <> a.target AND b.source <> b.target AND g.source <> g.target AND abs(g.shift - a.shift - b.shift) <= 40)",
    "parallel_edges": _E + " SELECT source, target, overlap_len, identity, paf_line, n - 1 AS others FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY overlap_len DESC, identity DESC, matches DESC, paf_line) AS k, count(*) OVER (PARTITION BY source, target) AS n FROM e) WHERE k = 1",
    "parallel_ports": _E + " SELECT source, target, paf_line FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY round(identity * 1000 + overlap_len + 0.1 - block * 0.01, 6) DESC, paf_line) AS k FROM e) WHERE k = 1",
    "quality_filter": _E + " SELECT source, target, paf_line FROM e WHERE overlap_len >= 100 AND identity >= 0.985 AND block - overlap_len <= 2",
    "overlap_classes": "WITH " + inputs.PAF + """ SELECT line_no, CASE WHEN block < 60 OR n_match / block < 0.98 THEN 'TOO_SHORT' WHEN q_st <= 5 AND q_len - q_en <= 5 AND q_len < t_len THEN 'Q_CONTAINED' WHEN t_st <= 5 AND t_len - t_en <= 5 AND t_len < q_len THEN 'T_CONTAINED'
        WHEN (q_st <= 5 OR q_len - q_en <= 5) AND (t_st <= 5 OR t_len - t_en <= 5) THEN 'DOVETAIL' ELSE 'INTERNAL' END AS kind FROM paf""",
    "strongest_incident": _E + """, a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight_dp DESC, overlap_len DESC, paf_line) AS s, row_number() OVER (PARTITION BY target ORDER BY weight_dp DESC, overlap_len DESC, paf_line) AS t FROM e WHERE weight_dp IS NOT NULL)
        SELECT DISTINCT source, target, paf_line FROM a WHERE s = 1 OR t = 1""",
    "best_outgoing": _E + " SELECT left_id, right_id, overlap_len FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY overlap_len DESC, paf_line) AS k FROM e) WHERE k = 1",
    "top_edges": _E + " SELECT source, target, overlap_len, paf_line FROM e ORDER BY overlap_len DESC, identity DESC, paf_line, source, target LIMIT 100",
    "forced_unitig_edges": _GRAPH + _FORCED + " SELECT source, target FROM f",
    "unitig_chains": _GRAPH + _FORCED + " SELECT node, head, position FROM ch",
    "unitig_contraction": _GRAPH + _FORCED + " SELECT DISTINCT coalesce(a.head, g.source) AS source, coalesce(b.head, g.target) AS target FROM g LEFT JOIN ch a ON a.node = g.source LEFT JOIN ch b ON b.node = g.target WHERE a.head IS NULL OR b.head IS NULL OR a.head <> b.head",
    "scc_contraction": _GRAPH + _STRONG + """, big AS (SELECT node, 'block:' || component AS b FROM scc WHERE component IN (SELECT component FROM scc GROUP BY component HAVING count(*) > 1))
        SELECT coalesce(a.b, source) AS src, coalesce(b.b, target) AS dst, source AS src_port, target AS dst_port FROM g LEFT JOIN big a ON a.node = source LEFT JOIN big b ON b.node = target WHERE a.b IS NULL OR b.b IS NULL OR a.b <> b.b""",
    "repeat_blocks": _GRAPH + """, hub AS (SELECT source AS node FROM og GROUP BY source HAVING count(DISTINCT target) >= 6 INTERSECT SELECT target FROM og GROUP BY target HAVING count(DISTINCT source) >= 6),
        hg AS (SELECT source, target FROM og WHERE source IN (SELECT node FROM hub) AND target IN (SELECT node FROM hub) AND source <> target)""" + _WEAK.replace("{0}", "hg") + " SELECT node, component FROM low",
    "boundary_edges": _GRAPH + _REGION + " SELECT region, source, target, kind FROM bk",
    "region_compression": _GRAPH + _REGION + """ SELECT i.region, i.n * o.n AS macro_edges, entries, exits FROM (SELECT region, count(*) AS n, count(DISTINCT target) AS entries FROM bk WHERE kind = 'incoming' GROUP BY region) i
        JOIN (SELECT region, count(*) AS n, count(DISTINCT source) AS exits FROM bk WHERE kind = 'outgoing' GROUP BY region) o USING (region)""",
    "path_levels": _DAG + " SELECT node, level FROM lv",
    "longest_path_dag": _DAG + " SELECT max(level) AS edges FROM lv",
    "cut_crossings": _CONTIG + """, sp AS (SELECT entity, least(a, b) AS lo, greatest(a, b) AS hi FROM ce WHERE a <> b), ev AS (SELECT entity, lo + 1 AS cut, 1 AS d FROM sp UNION ALL SELECT entity, hi + 1, -1 FROM sp),
        ag AS (SELECT entity, cut, sum(d) AS d FROM ev GROUP BY ALL) SELECT entity AS contig, cut, CAST(sum(d) OVER (PARTITION BY entity ORDER BY cut) AS BIGINT) AS crossing FROM ag""",
    "circular_layout": _CONTIG + """, se AS (SELECT entity, source, target, min(abs(shift) + 1) AS shift FROM ce GROUP BY ALL), an AS (SELECT entity, min(source) AS node FROM ce GROUP BY entity),
        p(entity, node, position) USING KEY (entity, node) AS (SELECT entity, node, CAST(0 AS BIGINT) FROM an UNION
            SELECT p.entity, se.target, min(p.position + se.shift) FROM p JOIN se ON se.entity = p.entity AND se.source = p.node LEFT JOIN recurring.p AS cur ON cur.entity = p.entity AND cur.node = se.target WHERE cur.node IS NULL OR p.position + se.shift < cur.position GROUP BY p.entity, se.target)
        SELECT entity, node, position FROM p""",
}
SQL["circular_windows"] = SQL["circular_layout"].rsplit("SELECT entity, node, position FROM p", 1)[0] + """, w AS (SELECT entity, node, row_number() OVER (PARTITION BY entity ORDER BY position, node) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM p)
    SELECT entity, node, CAST(floor(i * greatest(1, CAST(round(n / 8) AS BIGINT)) / n) AS BIGINT) AS "window" FROM w"""
from .paf_plans import _BASE as _PAF_BASE  # noqa: E402

SQL["full_cov_groups"] = _PAF_BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """, fl AS (SELECT q_id AS source, t_id AS target FROM fcov)""" + _WEAK.replace("{0}", "fl") + """,
    dg AS (SELECT rid, count(*) AS d FROM (SELECT left_id AS rid, right_id AS o FROM e UNION ALL SELECT right_id, left_id FROM e) WHERE rid IN (SELECT rid FROM r) AND o IN (SELECT rid FROM r) GROUP BY rid),
    q AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY length(seq) DESC, coalesce(d, 0) DESC, node DESC) AS k FROM low JOIN r ON r.rid = node LEFT JOIN dg ON dg.rid = node)
    SELECT q.node AS rid, 'full_coverage_with:' || b.node AS reason FROM q JOIN q b ON b.component = q.component AND b.k = 1 WHERE q.k > 1"""

_LAYOUT = SQL["circular_layout"].rsplit("SELECT entity, node, position FROM p", 1)[0]
_WINDOWS = SQL["circular_windows"].rsplit("SELECT entity, node, CAST(floor(", 1)[0] + """, wn AS (SELECT entity, node, CAST(floor(i * greatest(1, CAST(round(n / 8) AS BIGINT)) / n) AS BIGINT) AS w FROM w),
    ww AS (SELECT d.entity, d.source, d.target, a.w AS ws, b.w AS wt FROM (SELECT DISTINCT entity, source, target FROM ce) d JOIN wn a ON a.entity = d.entity AND a.node = d.source JOIN wn b ON b.entity = d.entity AND b.node = d.target),
    wg AS (SELECT entity, ws AS "window", source, target, ws = wt AS core FROM ww UNION ALL SELECT entity, wt, source, target, false FROM ww WHERE ws <> wt)"""
SQL |= {
    "cycle_components": _GRAPH + _STRONG + """,
        cy AS (SELECT d.source, d.target, a.component FROM (SELECT DISTINCT source, target FROM g WHERE source <> target) d JOIN scc a ON a.node = d.source JOIN scc b ON b.node = d.target WHERE a.component = b.component),
        gd AS (SELECT component, count(*) AS n FROM cy GROUP BY component HAVING count(*) = count(DISTINCT source) AND count(*) = count(DISTINCT target)),
        wk(component, node, path) AS (SELECT component, component, [component] FROM gd UNION ALL SELECT wk.component, cy.target, list_append(path, cy.target) FROM wk JOIN cy ON cy.source = wk.node WHERE cy.target <> wk.component),
        bp AS (SELECT component, arg_max(path, len(path)) AS c FROM wk GROUP BY component)
        SELECT component, CAST(len(c) AS BIGINT) AS nodes, array_to_string(c, ',') AS cycle, array_to_string(list_concat(c[len(c) // 2 + 1:], c[1:1]), ',') AS part FROM bp""",
    "region_closure": _GRAPH + _REGION + """,
        fw(region, node) AS (SELECT rs, target FROM be WHERE rs IS NOT NULL AND rt IS DISTINCT FROM rs UNION SELECT region, target FROM fw JOIN g ON g.source = fw.node),
        bw(region, node) AS (SELECT rt, source FROM be WHERE rt IS NOT NULL AND rs IS DISTINCT FROM rt UNION SELECT region, source FROM bw JOIN g ON g.target = bw.node)
        SELECT region, count(*) AS nodes FROM (SELECT region, node FROM m UNION SELECT fw.region, fw.node FROM fw JOIN bw ON bw.region = fw.region AND bw.node = fw.node) GROUP BY region""",
    "layout_residuals": _LAYOUT + """, ci AS (SELECT ce.entity, min(p.position + abs(shift) + 1) AS c FROM ce JOIN an ON an.entity = ce.entity AND an.node = ce.target JOIN p ON p.entity = ce.entity AND p.node = ce.source GROUP BY ce.entity),
        rs AS (SELECT ce.entity, abs(shift) + 1 - (b.position - a.position) AS d, c FROM ce JOIN p a ON a.entity = ce.entity AND a.node = ce.source JOIN p b ON b.entity = ce.entity AND b.node = ce.target JOIN ci ON ci.entity = ce.entity)
        SELECT entity, ((d % c) + c) % c AS residual, count(*) AS n FROM rs GROUP BY ALL""",
    "window_graphs": _WINDOWS + ' SELECT entity, "window", source, target, core FROM wg',
    "macro_expansion": _GRAPH + _FORCED + " SELECT 't:' || substr(head, 1, 3) AS root, count(*) AS leaves, count(DISTINCT node) AS nodes FROM ch GROUP BY 1",
}
SQL["safe_unitigs"] = _GRAPH + _FORCED + """, bad AS (SELECT DISTINCT a.head FROM g JOIN ch a ON a.node = g.source JOIN ch b ON b.node = g.target WHERE a.head = b.head AND a.position >= b.position), nd AS (SELECT source AS node FROM g UNION SELECT target FROM g)
    SELECT nd.node, coalesce(ch.head, nd.node) AS mapped FROM nd LEFT JOIN ch ON ch.node = nd.node AND ch.head NOT IN (SELECT head FROM bad)"""
SQL["region_checks"] = _GRAPH + _FORCED + _REGION + """,
    bl AS (SELECT DISTINCT a.head AS block, g.source, g.target FROM g JOIN ch a ON a.node = g.source JOIN ch b ON b.node = g.target WHERE a.head = b.head AND b.position = a.position + 1),
    tc AS (SELECT DISTINCT m.region, bl.block, source, target FROM bl JOIN m ON m.node = bl.source OR m.node = bl.target), ti AS (SELECT tc.*, x.node IS NOT NULL AND y.node IS NOT NULL AS inside FROM tc LEFT JOIN m x ON x.region = tc.region AND x.node = source LEFT JOIN m y ON y.region = tc.region AND y.node = target),
    tg AS (SELECT region, block, count(*) FILTER (inside) AS k, (SELECT count(*) FROM bl WHERE bl.block = ti.block) AS n FROM ti GROUP BY region, block), cut AS (SELECT DISTINCT region FROM tg WHERE k <> n AND NOT (n = 1 AND k = 0)),
    it AS (SELECT DISTINCT region, source, target FROM bk WHERE kind = 'internal'),
    f1(region, node) AS (SELECT region, target FROM bk WHERE kind = 'incoming' UNION SELECT it.region, it.target FROM f1 JOIN it ON it.region = f1.region AND it.source = f1.node),
    f2(region, node) AS (SELECT region, source FROM bk WHERE kind = 'outgoing' UNION SELECT it.region, it.source FROM f2 JOIN it ON it.region = f2.region AND it.target = f2.node),
    sp AS (SELECT region, bool_and((region, node) IN (SELECT (region, node) FROM f1) AND (region, node) IN (SELECT (region, node) FROM f2)) AS s FROM m GROUP BY region)
    SELECT region, region NOT IN (SELECT region FROM cut) AS atomic, s AS supported FROM sp"""
SQL["orientation_report"] = _RE + """, k AS (SELECT rid FROM r), i AS (SELECT * FROM e WHERE left_id IN (SELECT rid FROM k) AND right_id IN (SELECT rid FROM k)), pl AS (SELECT DISTINCT left_id AS source, right_id AS target FROM i)""" + _WEAK.replace("{0}", "pl") + """
    SELECT (SELECT count(DISTINCT (least(left_id, right_id), greatest(left_id, right_id), left_orientation * right_orientation)) FROM i) AS constraints,
           (SELECT count(DISTINCT component) FROM low) + (SELECT count(*) FROM k WHERE rid NOT IN (SELECT node FROM low)) AS components, (SELECT count(*) FROM k) AS reads, true AS consistent"""
SQL["tips_removed"] = _GRAPH + """, gd AS (SELECT DISTINCT source, target FROM g), nn AS (SELECT source AS node FROM gd UNION SELECT target FROM gd), nl AS (SELECT node, length(seq) AS n FROM nn JOIN r ON rid = node[:-2]),
    th AS (SELECT node FROM nl WHERE n <= 600 AND n % 7 < 3),
    gone(node) USING KEY (node) AS (SELECT node FROM th WHERE node NOT IN (SELECT source FROM gd) OR node NOT IN (SELECT target FROM gd)
        UNION SELECT DISTINCT th.node FROM th, gone WHERE th.node NOT IN (SELECT node FROM recurring.gone) AND (th.node NOT IN (SELECT source FROM gd WHERE target NOT IN (SELECT node FROM recurring.gone))
              OR th.node NOT IN (SELECT target FROM gd WHERE source NOT IN (SELECT node FROM recurring.gone))))
    SELECT node FROM nl WHERE node NOT IN (SELECT node FROM gone)"""
SQL["bubbles"] = _GRAPH + _FORCED + """, nn AS (SELECT source AS node FROM g UNION SELECT target FROM g), sq AS (SELECT node, CASE WHEN node[-1] = '+' THEN seq ELSE reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) END AS seq FROM nn JOIN r ON rid = node[:-2]),
    ov AS (SELECT b.node, max(overlap_len) AS k FROM og JOIN ch a ON a.node = og.source JOIN ch b ON b.node = og.target WHERE a.head = b.head AND b.position = a.position + 1 GROUP BY b.node),
    sp AS (SELECT coalesce(head, sq.node) AS branch, string_agg(substr(seq, coalesce(k, 0) + 1), '' ORDER BY coalesce(position, 0)) AS spelled FROM sq LEFT JOIN ch ON ch.node = sq.node LEFT JOIN ov ON ov.node = sq.node GROUP BY 1),
    c AS (SELECT DISTINCT coalesce(a.head, g.source) AS source, coalesce(b.head, g.target) AS target FROM g LEFT JOIN ch a ON a.node = g.source LEFT JOIN ch b ON b.node = g.target WHERE g.source <> g.target AND (a.head IS NULL OR b.head IS NULL OR a.head <> b.head)),
    br AS (SELECT i.target AS branch, i.source AS a, o.target AS z FROM c i JOIN c o ON o.source = i.target WHERE i.target IN (SELECT target FROM c GROUP BY target HAVING count(*) = 1) AND i.target IN (SELECT source FROM c GROUP BY source HAVING count(*) = 1) AND i.source <> o.target),
    w AS (SELECT br.*, min(branch) OVER (PARTITION BY a, z, spelled) AS kept FROM br JOIN sp USING (branch))
    SELECT a AS source, z AS sink, kept, branch AS dropped FROM w WHERE branch <> kept"""
SQL["rebased_layout"] = _LAYOUT + """, ci AS (SELECT ce.entity, min(p.position + abs(shift) + 1) AS c FROM ce JOIN an ON an.entity = ce.entity AND an.node = ce.target JOIN p ON p.entity = ce.entity AND p.node = ce.source GROUP BY ce.entity),
    pm AS (SELECT p.entity, node, position % c AS position, c FROM p JOIN ci ON ci.entity = p.entity),
    ar AS (SELECT d.entity, a.position AS s, b.position AS t FROM (SELECT DISTINCT entity, source, target FROM ce) d JOIN pm a ON a.entity = d.entity AND a.node = d.source JOIN pm b ON b.entity = d.entity AND b.node = d.target WHERE a.position <> b.position),
    cr AS (SELECT x.entity, x.position, count(*) FILTER (CASE WHEN t > s THEN s < x.position AND x.position <= t ELSE s < x.position OR x.position <= t END) AS k FROM (SELECT DISTINCT entity, position FROM pm) x LEFT JOIN ar ON ar.entity = x.entity GROUP BY ALL),
    bs AS (SELECT entity, min({'k': k, 'p': position}) AS b FROM cr GROUP BY entity)
    SELECT pm.entity, node, (position - b.p + c) % c AS position, b.k AS wraps FROM pm JOIN bs ON bs.entity = pm.entity"""
SQL["region_tiers"] = _GRAPH + _REGION + """, it AS (SELECT DISTINCT region, source, target FROM bk WHERE kind = 'internal' AND source <> target), rr(region, a, b) AS (SELECT region, source, target FROM it UNION SELECT rr.region, a, target FROM rr JOIN it ON it.region = rr.region AND it.source = rr.b),
    cy AS (SELECT DISTINCT region FROM rr WHERE a = b), pp AS (SELECT region, k * (k - 1) // 2 AS p FROM (SELECT region, count(*) AS k FROM it GROUP BY region, source UNION ALL SELECT region, count(*) FROM it GROUP BY region, target)),
    z AS (SELECT m.region, (SELECT count(*) FROM it WHERE it.region = m.region) AS variables, CAST(coalesce((SELECT sum(p) FROM pp WHERE pp.region = m.region), 0) AS BIGINT) AS couplings FROM (SELECT DISTINCT region FROM m) m)
    SELECT region, variables, couplings, round(CASE WHEN variables > 0 THEN 2 * couplings / variables ELSE 0 END, 9) AS degree, CASE WHEN region NOT IN (SELECT region FROM cy) THEN 0 WHEN variables <= 40 THEN 1 WHEN variables <= 200 THEN 2 ELSE 99 END AS tier FROM z"""
WINDOW_COUNTS = _WINDOWS + ' SELECT entity, "window", count(*) AS edges, count(*) FILTER (core) AS core FROM wg GROUP BY ALL'
