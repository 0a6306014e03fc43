"""Queries that decode and judge solutions, and models of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dag as D
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import qubo as Q
from ..operators import regions as H
from ..operators.ranking import global_rank
from . import inputs
from .qubo_plans import _FIN, _graph, _numbered, _one, _out
from .score_plans import _RANKS, _ranks


def macro_edge_terms(spark, sf_dir):
    """Path models of every contig from its first read to its last."""
    nodes, edges = _graph(spark, sf_dir)
    ports = nodes.groupBy("model").agg(F.lit(0).cast("bigint").alias("entry"), (F.max("n") - 1).alias("exit"))
    return _out(Q.macro_edge_model(nodes, edges, ports).terms())


def circle_terms(spark, sf_dir):
    return _out(Q.circle_model(*_graph(spark, sf_dir, False)).terms())


def boundary_state_terms(spark, sf_dir):
    """Choice of one edge per contig."""
    _, edges = _graph(spark, sf_dir)
    return _out(Q.boundary_state_model(edges.select("model", "var", F.col("reward").alias("weight")), 10.0).terms())


def order_violations(spark, sf_dir):
    """Violations of an ordered-path sample that selects every second edge and sets every third bit of three."""
    _, edges = _graph(spark, sf_dir, False)
    m = edges.groupBy("model").agg(F.max("m").alias("m"))
    s = edges.where("var % 2 = 0").select("model", "var").unionByName(m.select("model", F.explode(F.sequence(F.col("m"), F.col("m") * 4 - 1)).alias("var")).where("var % 3 = 0"))
    return Q.order_violations(s, edges, 3)


def selected_fragments(spark, sf_dir):
    """Fragments of the selected edges of every contig: the best edge out of each read that is also the best into its target."""
    _, e = _graph(spark, sf_dir)
    out = e.groupBy("model", "li").agg(F.max(F.struct("reward", (-F.col("ri")).alias("x"))).alias("b")).select("model", "li", (-F.col("b.x")).alias("ri"), F.col("b.reward").alias("reward"))
    both = out.groupBy("model", "ri").agg(F.max(F.struct("reward", (-F.col("li")).alias("x"))).alias("b")).select("model", "ri", (-F.col("b.x")).alias("li"))
    name = lambda c: F.concat_ws("#", "model", F.format_string("%09d", F.col(c)))
    u = G.unitigs(both.select(name("li").alias("source"), name("ri").alias("target")))
    return u.groupBy("head").agg(F.count(F.lit(1)).alias("reads"))


def contiguous_reach(spark, sf_dir):
    """For every read: the earliest rank from which edges to overlapping later reads lead to it, and the ranks spanned."""
    k = _ranks(spark, sf_dir)
    e = E.recoverability_edges(inputs.edges(spark, sf_dir), k).where("direction = 'contiguous'").select(F.col("left_rank").alias("source"), F.col("right_rank").alias("target")).distinct()
    labels = k.select(F.col("rank").alias("node"), F.col("rank").alias("label"))
    r, _ = G.spread_labels(labels, e, 10_000)
    return r.select(F.col("node").cast("bigint").alias("rank"), F.col("label").cast("bigint").alias("earliest"), (F.col("node") - F.col("label")).cast("bigint").alias("span"))


def recovery_summary(spark, sf_dir):
    """One row: the longest span of ranks that contiguous edges join, and whether all reads are."""
    r = contiguous_reach(spark, sf_dir)
    return r.agg(F.max("span").alias("longest_span"), (F.max("span") == F.count(F.lit(1)) - 1).alias("full_recovery"))


def layout_connections(spark, sf_dir):
    """Neighbours of the layout by id: pairs with an edge, pairs that are truly adjacent as well, pairs without an edge."""
    k = _ranks(spark, sf_dir)
    p = global_rank(k.select("rid"), [F.col("rid")], "position")
    steps = p.select(F.col("rid").alias("left_id"), (F.col("position") + 1).alias("position")).join(p.select(F.col("rid").alias("right_id"), "position"), "position")
    have = inputs.edges(spark, sf_dir).select("left_id", "right_id").distinct().withColumn("edge", F.lit(True))
    true = E.true_adjacent(k).withColumn("adjacent", F.lit(True))
    j = steps.join(have, ["left_id", "right_id"], "left").join(true, ["left_id", "right_id"], "left")
    return j.agg(F.count_if("edge").alias("legal"), F.count_if(F.col("edge") & F.col("adjacent")).alias("legal_adjacent"), F.count_if(F.col("edge").isNull()).alias("missing"))


def edge_set_audit(spark, sf_dir):
    """Signatures of the stored edges against those rebuilt through a graph file: rows on one side only."""
    from .file_plans import gfa_roundtrip

    a = inputs.edges(spark, sf_dir).select(F.col("left_id").alias("s"), F.col("right_id").alias("t"), "left_orientation", "right_orientation", F.col("overlap_len").cast("string").alias("n"))
    g = gfa_roundtrip(spark, sf_dir)
    sign = lambda c: F.when(F.col(c) == "+", 1).otherwise(-1)
    b = g.select(F.col("source").alias("s"), F.col("target").alias("t"), sign("source_sign").alias("left_orientation"), sign("target_sign").alias("right_orientation"), F.regexp_replace("overlap", "M", "").alias("n"))
    parts = [x.exceptAll(y).agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("n")) for k, x, y in (("stored", a, b), ("rebuilt", b, a))]
    return parts[0].unionByName(parts[1])


def region_hierarchies(spark, sf_dir):
    """Blocks of every contig's graph, made one after the other."""
    nodes, edges = _graph(spark, sf_dir)
    g = edges.groupBy("model").agg(F.collect_list(F.struct("li", "ri")).alias("arcs")).join(nodes.groupBy("model").agg(F.max("n").alias("n")), "model")
    return H.hierarchies(g).select("model", "level", "block", F.size("members").alias("members"), "inside", "entries", "exits")


_FUNCTIONS = (macro_edge_terms, circle_terms, boundary_state_terms, order_violations, selected_fragments, contiguous_reach, recovery_summary, layout_connections, edge_set_audit, region_hierarchies)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_RE = "WITH RECURSIVE " + inputs.READS + "," + inputs.EDGES
_REACH = _RE + _RANKS + """,
    cg AS (SELECT DISTINCT a.rank AS s, b.rank AS t FROM e JOIN k a ON a.rid = left_id JOIN k b ON b.rid = right_id WHERE a.rank < b.rank AND a.true_end >= b.true_start),
    rr(rank, earliest) USING KEY (rank) AS (SELECT rank, rank FROM k UNION SELECT cg.t, min(rr.earliest) FROM rr JOIN cg ON cg.s = rr.rank JOIN recurring.rr AS cur ON cur.rank = cg.t WHERE rr.earliest < cur.earliest GROUP BY cg.t)"""
SQL = {
    "macro_edge_terms": _numbered(True) + """,
        pn AS (SELECT model, greatest(10.0, 4 * sum(abs(reward)) + 1) AS pen FROM ed GROUP BY model),
        gi AS (SELECT ed.model, 2 * ri AS form, var, pen FROM ed JOIN pn USING (model) WHERE ri <> 0 UNION ALL SELECT ed.model, 2 * li + 1, var, pen FROM ed JOIN pn USING (model) WHERE li <> n - 1),
        fn AS (SELECT nd.model, pen FROM nd JOIN pn USING (model) WHERE idx <> 0 UNION ALL SELECT nd.model, pen FROM nd JOIN pn USING (model) WHERE idx <> n - 1),
        t AS (SELECT model, -1 AS i, -1 AS j, CAST(pen AS DOUBLE) AS c FROM fn UNION ALL SELECT model, var, var, -pen FROM gi UNION ALL SELECT a.model, a.var, b.var, 2 * a.pen FROM gi a JOIN gi b ON a.model = b.model AND a.form = b.form AND a.var < b.var
            UNION ALL SELECT model, var, var, -reward FROM ed UNION ALL SELECT ed.model, var, var, pen FROM ed JOIN pn USING (model) WHERE ri = 0 UNION ALL SELECT ed.model, var, var, pen FROM ed JOIN pn USING (model) WHERE li = n - 1)""" + _FIN,
    "circle_terms": _numbered(False) + """, fl AS (SELECT model, ri AS form, var, CAST(1 AS DOUBLE) AS c FROM ed UNION ALL SELECT model, li, var, -1 FROM ed),
        t AS (SELECT model, var AS i, var AS j, 100 * c * c AS c FROM fl UNION ALL SELECT a.model, a.var, b.var, 200 * a.c * b.c FROM fl a JOIN fl b ON a.model = b.model AND a.form = b.form AND a.var < b.var
            UNION ALL SELECT a.model, a.var, b.var, 100 FROM ed a JOIN ed b ON a.model = b.model AND a.li = b.li AND a.var < b.var UNION ALL SELECT a.model, a.var, b.var, 100 FROM ed a JOIN ed b ON a.model = b.model AND a.ri = b.ri AND a.var < b.var
            UNION ALL SELECT model, var, var, -(1 + CAST(0.1 AS DOUBLE) * reward) FROM ed)""" + _FIN,
    "boundary_state_terms": _numbered(True) + ", gs AS (SELECT model, 0 AS form, var FROM ed), fm AS (SELECT DISTINCT model, 0 AS form FROM ed), t AS (" + _one("gs", "fm", "10") + " UNION ALL SELECT model, var, var, -reward FROM ed)" + _FIN,
    "order_violations": _numbered(False) + """, mm AS (SELECT model, max(m) AS m FROM ed GROUP BY model), sl AS (SELECT model, li, ri, var FROM ed WHERE var % 2 = 0),
        zb AS (SELECT model, v, m, (v - m) // 3 AS var, 2 ** ((v - m) % 3) AS w FROM (SELECT model, m, unnest(range(m, 4 * m)) AS v FROM mm) WHERE v % 3 = 0),
        gh AS (SELECT model, count(*) AS g FROM zb WHERE (model, var) NOT IN (SELECT (model, var) FROM sl) GROUP BY model),
        ps AS (SELECT sl.model, li, ri, 1 + coalesce(sum(w), 0) AS p FROM sl LEFT JOIN zb ON zb.model = sl.model AND zb.var = sl.var GROUP BY sl.model, li, ri, sl.var),
        ov AS (SELECT a.model, count(*) AS o FROM ps a JOIN ps b ON b.model = a.model AND b.ri = a.li WHERE a.p <> b.p + 1 GROUP BY a.model)
        SELECT model, coalesce(g, 0) AS ghost_bits, coalesce(o, 0) AS order_violations FROM mm LEFT JOIN gh USING (model) LEFT JOIN ov USING (model)""",
    "selected_fragments": _numbered(True) + """, bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, li ORDER BY reward DESC, ri) AS k FROM ed) WHERE k = 1), bi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ri ORDER BY reward DESC, li) AS k2 FROM bo) WHERE k2 = 1),
        ch(model, node, head) AS (SELECT model, li, li FROM bi WHERE (model, li) NOT IN (SELECT (model, ri) FROM bi) UNION ALL SELECT bi.model, bi.ri, head FROM ch JOIN bi ON bi.model = ch.model AND bi.li = ch.node)
        SELECT model || '#' || lpad(CAST(head AS VARCHAR), 9, '0') AS head, count(*) AS reads FROM ch GROUP BY model, head""",
    "contiguous_reach": _REACH + " SELECT rank, earliest, rank - earliest AS span FROM rr",
    "recovery_summary": _REACH + " SELECT max(rank - earliest) AS longest_span, max(rank - earliest) = count(*) - 1 AS full_recovery FROM rr",
    "layout_connections": _RE + _RANKS + """, p AS (SELECT rid, row_number() OVER (ORDER BY rid) AS i FROM k), s AS (SELECT a.rid AS left_id, b.rid AS right_id FROM p a JOIN p b ON b.i = a.i + 1),
        h AS (SELECT s.*, (left_id, right_id) IN (SELECT (left_id, right_id) FROM e) AS edge, (left_id, right_id) IN (SELECT (left_id, right_id) FROM adj) AS adjacent FROM s)
        SELECT count(*) FILTER (edge) AS legal, count(*) FILTER (edge AND adjacent) AS legal_adjacent, count(*) FILTER (NOT edge) AS missing FROM h""",
    "edge_set_audit": "SELECT 'stored' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'rebuilt', 0",
}
