"""Queries of CIGAR strings, dovetails, expected errors, spans, structural weights, windows by ports and missing sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import dag as D
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import paf as P
from ..operators.ranking import entity_rank
from ..session import new_path, table
from ..sources import files as R
from ..sources import sinks as W
from . import inputs
from .graph_plans import SQL as _GRAPH_SQL
from .graph_plans import _best, _evidence, _layout, clean_graph
from .graph_plans import _FORCED, _GRAPH, _LAYOUT
from .paf_plans import SQL as _PAF_SQL
from .paf_plans import _BASE, CONFIG, _records


def cigar_alignments(spark, sf_dir):
    """A CIGAR string with free ends laid over every read of at least 60 bases and its complement."""
    r = inputs.reads(spark, sf_dir).where("length(seq) >= 60").withColumn("t", S.revcomp("seq"))
    d = r.select("rid", S.decode_cigar(F.lit("3I20=2X4I10=3D5=6D"), "seq", "t").alias("x"))
    return d.select("rid", "x.*")


def dovetail_edges(spark, sf_dir):
    """Strict outward overlaps and containments of the alignments, their CIGAR strings made from matches and block."""
    cigar = F.concat(F.col("n_match").cast("string"), F.lit("="), F.greatest(F.lit(0), F.col("block") - F.col("n_match")).cast("string"), F.lit("X"))
    d = P.exact_dovetails(inputs.paf_fields(spark, sf_dir).withColumn("cigar", cigar))
    return d.select("kind", "source", "target", F.round("identity", 9).alias("identity"), "columns", "line_no")


def error_expectations(spark, sf_dir):
    """Expected identity and errors for rates that follow from the lengths of the contigs."""
    m, i, d = ((F.col("length") % n) / 100.0 for n in (31, 7, 5))
    c = table(spark, sf_dir, "contigs")
    return c.select("contig", F.round(S.expected_identity(m), 12).alias("identity"), F.round(S.expected_read_errors(i, d, m), 12).alias("per_read"), F.round(S.expected_pair_errors(i, d, m), 12).alias("per_pair"))


def cyclic_spans(spark, sf_dir):
    """The shortest stretch of each circular contig that holds the starts of all placements; gaps between neighbours by rank, so a contig with most rows is spread."""
    c = table(spark, sf_dir, "contigs").where("topology = 'circular' and length > 0").select("contig", "length")
    p = table(spark, sf_dir, "placements").where("reference_start >= 0").join(c, "contig").select("contig", "length", (F.col("reference_start") % F.col("length")).alias("start")).distinct()
    r = entity_rank(p, ["contig"], "start", [])
    nxt = r.select("contig", (F.col("rank") - 1).alias("rank"), F.col("start").alias("next"))
    gaps = r.join(nxt, ["contig", "rank"]).groupBy("contig").agg(F.max(F.col("next") - F.col("start")).alias("gap"))
    ends = r.groupBy("contig", "length").agg(F.count(F.lit(1)).alias("starts"), F.min("start").alias("lo"), F.max("start").alias("hi"))
    wide = F.greatest(F.coalesce("gap", F.lit(0)), F.col("lo") + F.col("length") - F.col("hi"))
    return ends.join(gaps, "contig", "left").select("contig", "starts", F.when(F.col("starts") > 1, F.col("length") - wide).otherwise(0).cast("bigint").alias("span"))


def mirrored_identity(spark, sf_dir):
    """Share of equal bases of every read and itself read backwards, and the circular span of three of its bases' places."""
    r = inputs.reads(spark, sf_dir)
    n = F.length("seq").cast("bigint")
    at = F.array(n % 7, (n * 5) % 97, (n * 3) % 53)
    return r.select("rid", F.round(S.ungapped_identity("seq", F.reverse("seq")), 9).alias("identity"), S.cyclic_span(at, F.lit(100).cast("bigint")).alias("span"))


def structural_weights(spark, sf_dir):
    """Weight of every edge of the graph with its chains contracted: how many reads its target stands for."""
    e = _best(spark, sf_dir).select("source", "target")
    u = G.unitigs(e)
    sizes = u.groupBy("head").agg(F.count(F.lit(1)).alias("weight"))
    c = G.contract_unitigs(e, u)
    return c.join(sizes.withColumnRenamed("head", "target"), "target", "left").select("source", "target", F.coalesce("weight", F.lit(1).cast("bigint")).alias("weight"))


def canonical_cycles(spark, sf_dir):
    """Reads of each contig by start, rotated to begin with the smallest id."""
    n = table(spark, sf_dir, "nodes").where("contig is not null and read_id is not null and start >= 0").groupBy("contig", "read_id").agg(F.min("start").alias("start"))
    d = n.groupBy("contig").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "read_id"))), lambda x: x["read_id"]).alias("t"))  # a cycle is one value
    return d.select("contig", F.array_join(S.canonical_rotation("t"), ",").alias("rotated"))


def _port_windows(spark, sf_dir):
    e, _, p = _layout(spark, sf_dir)
    return e, p, D.port_windows(p, e, 8)


def port_windows(spark, sf_dir):
    """Per contig: nodes, whether windows are consecutive by position, and whether the largest product of crossings is no larger than that of balanced windows."""
    _, _, w = _port_windows(spark, sf_dir)
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / 8)).cast("int")
    whole, more = F.floor(F.col("n") / count).cast("int"), (F.col("n") % count).cast("int")
    even = F.transform(F.sequence(F.lit(1), count), lambda k: (k * whole + F.least(k, more)).cast("bigint"))
    worst = lambda cuts: F.array_max(F.transform(cuts, lambda c, i: F.get("crossing", F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(cuts, i - 1)).cast("int")) * F.get("crossing", c.cast("int"))))
    per = w.groupBy("entity", "window").agg(F.count(F.lit(1)).alias("k"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("entity").orderBy("window"))  # a row per window
    ordered = per.withColumn("ok", F.coalesce(before <= F.col("lo"), F.lit(True))).groupBy("entity").agg(F.sum("k").alias("n"), F.bool_and("ok").alias("ordered"))
    cuts = w.groupBy("entity").agg(F.any_value("cuts").alias("cuts"), F.any_value("crossing").alias("crossing"))
    return ordered.join(cuts, "entity").select("entity", F.col("n").alias("nodes"), "ordered", (worst(F.col("cuts")) <= worst(even)).alias("no_worse"))


def window_dataset(spark, sf_dir):
    """The window dataset written and read back: per contig nodes, edges inside windows, edges across, and lines of both formats."""
    e, p, _ = _port_windows(spark, sf_dir)
    seqs = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct().withColumn("seq", F.lit("ACGT"))
    path = new_path(spark, "windows")
    W.write_window_dataset(D.circular_windows(p, 8), e.withColumn("overlap_len", F.col("shift")), seqs, path)
    m = spark.read.parquet(f"{path}/manifest").groupBy("entity").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.sum("incoming").alias("across"), F.count(F.lit(1)).alias("windows"))
    lines = None
    for kind, node, edge in (("graphml", "<node%", "<edge%"), ("gfa", "S\t%", "L\t%")):
        t = spark.read.text(f"{path}/{kind}").groupBy("entity").agg(F.count_if(F.col("value").like(node)).alias(f"{kind}_nodes"), F.count_if(F.col("value").like(edge)).alias(f"{kind}_edges"))
        lines = t if lines is None else lines.join(t, "entity")
    return m.join(lines, "entity")


def missing_side_causes(spark, sf_dir):
    """For every placed read without edges in or out in the cleaned graph: why, from what its two neighbours on the contig on each side have."""
    e = inputs.edges(spark, sf_dir)
    gone = G.contained_reads(inputs.reads(spark, sf_dir), _evidence(spark, sf_dir)).select("rid")
    projected = e.join(gone.withColumnRenamed("rid", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("rid", "right_id"), "right_id", "left_anti").select("source", "target")
    final = clean_graph(spark, sf_dir).select("source", "target")
    p = E.best_placements(table(spark, sf_dir, "placements")).select(F.concat("read_id", F.when(F.col("orientation") == -1, "-").otherwise("+")).alias("node"), "contig", "reference_start")
    r = entity_rank(p, ["contig"], "reference_start", ["node"]).select("contig", "node", "rank", "rank_n")
    steps = r.select("contig", "node", "rank", "rank_n", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("k"))
    at = F.pmod(F.col("rank") + F.col("k"), F.col("rank_n"))
    near = steps.select("contig", "node", at.alias("rank")).join(r.select("contig", F.col("node").alias("other"), "rank"), ["contig", "rank"]).where("node <> other").select("node", "other").distinct()
    no = lambda side, end: p.select("node").distinct().join(final.select(F.col(end).alias("node")).distinct(), "node", "left_anti").withColumn("side", F.lit(side))
    return E.missing_side_causes(no("in", "target").unionByName(no("out", "source")), near, e.select("source", "target"), projected, final, P.pair_audit(_records(spark, sf_dir), CONFIG))


def cycle_table_roundtrip(spark, sf_dir):
    """A cycle of the nodes of every contig as a tab-separated table and back."""
    n = table(spark, sf_dir, "nodes").where("contig is not null and node is not null").groupBy("contig", "node").agg(F.min("reference_index").alias("reference_index"))
    path = new_path(spark, "cycle")
    n.select("contig", "node", "reference_index").write.csv(path, sep="\t", header=True)
    return R.read_table(spark, path, "contig string, node string, reference_index bigint").groupBy("contig").agg(F.count(F.lit(1)).alias("nodes"), F.sum("reference_index").alias("indices"))


def reference_roundtrip(spark, sf_dir):
    """The control reads as one reference file, read whole and as text."""
    path = new_path(spark, "reference")
    r = table(spark, sf_dir, "control_reads").where("seq <> ''").groupBy("rid").agg(F.max(F.upper("seq")).alias("seq"))
    W.write_lines(W.fasta_rows(r).orderBy("line"), path, 1)
    seq = R.read_reference(spark, path)
    text = R.read_text(spark, path).select(F.length("text").cast("bigint").alias("characters"), F.lit(len(seq)).cast("bigint").alias("bases"), F.md5(F.lit(seq)).alias("digest"))
    return text.where("characters > 0")


_FUNCTIONS = (
    cigar_alignments, dovetail_edges, error_expectations, cyclic_spans, mirrored_identity, structural_weights, canonical_cycles, port_windows, window_dataset, missing_side_causes, cycle_table_roundtrip, reference_roundtrip,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CLEAN = _GRAPH_SQL["clean_graph"].rsplit(" SELECT source, target, paf_line FROM e1", 1)[0].replace("WITH RECURSIVE " + inputs.READS + "," + inputs.EDGES, "", 1).replace("ev AS", "evd AS").replace("FROM ev v", "FROM evd v")
_PLACED = """, bp AS (SELECT read_id || CASE WHEN orientation = -1 THEN '-' ELSE '+' END AS node, contig, reference_start FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY reference_end - reference_start DESC, coalesce(identity, -1) DESC, coalesce(mapq, -1) DESC, contig DESC, reference_start) AS k
    FROM placements WHERE read_id IS NOT NULL AND contig IS NOT NULL AND reference_start >= 0 AND reference_start < reference_end) WHERE k = 1)"""
SQL = {
    "cigar_alignments": "WITH " + inputs.READS + """, x AS (SELECT rid, seq AS q, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS t FROM r WHERE length(seq) >= 60)
        SELECT rid, substr(q, 4, 36) || '---' || substr(q, 40, 5) AS aligned_query, substr(t, 1, 22) || '----' || substr(t, 23, 18) AS aligned_target,
               CAST(3 AS BIGINT) AS q_start, CAST(44 AS BIGINT) AS q_end, CAST(0 AS BIGINT) AS t_start, CAST(40 AS BIGINT) AS t_end FROM x""",
    "dovetail_edges": "WITH " + inputs.PAF + """, x AS (SELECT *, CASE WHEN strand = '+' THEN t_st ELSE t_len - t_en END AS a, CASE WHEN strand = '+' THEN t_len - t_en ELSE t_st END AS b, q_len - q_en AS z,
            least(100, greatest(5, floor(least(q_en - q_st, t_en - t_st) * 0.02))) AS tol, n_match + greatest(0, block - n_match) AS cols FROM paf WHERE q_id <> t_id),
        y AS (SELECT 'contained' AS kind, q_id AS source, t_id AS target, * FROM x WHERE q_st <= tol AND z <= tol UNION ALL SELECT 'contained', t_id, q_id, * FROM x WHERE a <= tol AND b <= tol
            UNION ALL SELECT 'edge', q_id || '+', t_id || strand, * FROM x WHERE z <= tol AND a <= tol AND q_st > tol AND b > tol UNION ALL SELECT 'edge', t_id || strand, q_id || '+', * FROM x WHERE b <= tol AND q_st <= tol AND a > tol AND z > tol)
        SELECT kind, source, target, round(CASE WHEN cols > 0 THEN n_match / cols END, 9) AS identity, cols AS columns, line_no FROM y""",
    "error_expectations": """WITH c AS (SELECT contig, CAST(length % 31 AS DOUBLE) / 100 AS m, CAST(length % 7 AS DOUBLE) / 100 AS i, CAST(length % 5 AS DOUBLE) / 100 AS d FROM contigs), x AS (SELECT *, (1 - m) ** 2 + m * m / 3 AS same FROM c)
        SELECT contig, round(same, 12) AS identity, round(i + d + (1 - d) * m, 12) AS per_read, round((1 - d) ** 2 * (1 - same) + 2 * d * (1 - d) + 2 * i, 12) AS per_pair FROM x""",
    "cyclic_spans": """WITH p AS (SELECT DISTINCT p.contig, c.length AS n, reference_start % c.length AS s FROM placements p JOIN contigs c ON c.contig = p.contig WHERE topology = 'circular' AND c.length > 0 AND reference_start >= 0),
        g AS (SELECT contig, n, s, coalesce(lead(s) OVER (PARTITION BY contig ORDER BY s), min(s) OVER (PARTITION BY contig) + n) - s AS gap FROM p)
        SELECT contig, count(*) AS starts, CAST(CASE WHEN count(*) > 1 THEN max(n) - max(gap) ELSE 0 END AS BIGINT) AS span FROM g GROUP BY contig""",
    "mirrored_identity": "WITH " + inputs.READS + """, x AS (SELECT rid, seq, list_sort([length(seq) % 7, length(seq) * 5 % 97, length(seq) * 3 % 53]) AS v FROM r)
        SELECT rid, round((length(seq) - hamming(seq, reverse(seq))) / length(seq), 9) AS identity, CAST(100 - greatest(v[2] - v[1], v[3] - v[2], (v[1] - v[3] + 100) % 100) AS BIGINT) AS span FROM x""",
    "structural_weights": _GRAPH + _FORCED + """, c AS (SELECT DISTINCT coalesce(a.head, g.source) AS source, coalesce(b.head, g.target) AS target FROM g LEFT JOIN ch a ON a.node = g.source LEFT JOIN ch b ON b.node = g.target WHERE a.head IS NULL OR b.head IS NULL OR a.head <> b.head)
        SELECT source, target, coalesce(k, 1) AS weight FROM c LEFT JOIN (SELECT head, count(*) AS k FROM ch GROUP BY head) h ON h.head = c.target""",
    "canonical_cycles": """WITH n AS (SELECT contig, read_id, min(start) AS start FROM nodes WHERE contig IS NOT NULL AND read_id IS NOT NULL AND start >= 0 GROUP BY ALL), l AS (SELECT contig, list(read_id ORDER BY start, read_id) AS t FROM n GROUP BY contig)
        SELECT contig, array_to_string(list_concat(t[list_position(t, list_min(t)):], t[1:list_position(t, list_min(t)) - 1]), ',') AS rotated FROM l""",
    "port_windows": _LAYOUT + " SELECT entity, count(*) AS nodes, true AS ordered, true AS no_worse FROM p GROUP BY entity",
    "window_dataset": _GRAPH_SQL["window_graphs"].rsplit(" SELECT entity,", 1)[0] + """, i AS (SELECT entity, count(*) FILTER (ws = wt) AS edges, count(*) FILTER (ws <> wt) AS across FROM ww GROUP BY entity)
        SELECT n.entity, nodes, edges, across, windows, nodes AS graphml_nodes, edges AS graphml_edges, nodes AS gfa_nodes, edges AS gfa_edges FROM (SELECT entity, count(*) AS nodes, count(DISTINCT w) AS windows FROM wn GROUP BY entity) n JOIN i USING (entity)""",
    "missing_side_causes": _BASE + _CLEAN + """, fin AS (SELECT source, target FROM e1 WHERE left_id NOT IN (SELECT rid FROM weak) AND right_id NOT IN (SELECT rid FROM weak)), au AS (SELECT * FROM (AUDIT))""" + _PLACED + """,
        rkk AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY reference_start, node) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n FROM bp),
        nb AS (SELECT DISTINCT x.node, y.node AS other FROM rkk x, (SELECT unnest([-2, -1, 1, 2]) AS k), rkk y WHERE y.contig = x.contig AND y.i = (x.i + k + 2 * x.n) % x.n AND y.node <> x.node),
        sd AS (SELECT DISTINCT node, 'in' AS side FROM bp WHERE node NOT IN (SELECT target FROM fin) UNION SELECT DISTINCT node, 'out' FROM bp WHERE node NOT IN (SELECT source FROM fin)),
        d AS (SELECT sd.node, side, other, CASE WHEN side = 'in' THEN other ELSE sd.node END AS s, CASE WHEN side = 'in' THEN sd.node ELSE other END AS t, least(sd.node[:-2], other[:-2]) AS a, greatest(sd.node[:-2], other[:-2]) AS b FROM sd JOIN nb USING (node)),
        kp AS (SELECT DISTINCT source, target, least(left_id, right_id) AS a, greatest(left_id, right_id) AS b FROM e1), kc AS (SELECT DISTINCT source, target, least(left_id, right_id) AS a, greatest(left_id, right_id) AS b FROM e),
        st2 AS (SELECT d.node, side, CASE WHEN (s, t) IN (SELECT (source, target) FROM fin) THEN 1 WHEN (s, t) IN (SELECT (source, target) FROM kp) THEN 2 WHEN (s, t) IN (SELECT (source, target) FROM kc) THEN 3
            WHEN (a, b) IN (SELECT (a, b) FROM kp) THEN 4 WHEN (a, b) IN (SELECT (a, b) FROM kc) THEN 5 ELSE CASE status WHEN 'passes' THEN 6 WHEN 'geometry' THEN 7 WHEN 'error_hint' THEN 8 WHEN 'identity' THEN 9 WHEN 'overlap' THEN 10 ELSE 11 END END AS c
            FROM d LEFT JOIN au ON first_id = a AND second_id = b),
        mn AS (SELECT node, side, count(*) AS k, min(c) AS c FROM st2 GROUP BY ALL)
        SELECT sd.node, sd.side, coalesce(k, 0) AS neighbours, CASE WHEN c IS NULL THEN 'no_nearby_retained_read' ELSE CAUSES[c] END AS cause FROM sd LEFT JOIN mn ON mn.node = sd.node AND mn.side = sd.side""".replace("CAUSES", str(list(E.SIDE_CAUSES))),
    "cycle_table_roundtrip": """SELECT contig, count(*) AS nodes, CAST(sum(i) AS BIGINT) AS indices FROM (SELECT contig, node, min(reference_index) AS i FROM nodes WHERE contig IS NOT NULL AND node IS NOT NULL GROUP BY ALL) GROUP BY contig""",
    "reference_roundtrip": """WITH r AS (SELECT rid, max(upper(seq)) AS seq FROM control_reads WHERE seq <> '' AND rid IS NOT NULL GROUP BY rid), w AS (SELECT string_agg(seq, '' ORDER BY rid) AS s, sum(2 + length(rid) + length(seq) + ceil(length(seq) / 80)) AS n FROM r)
        SELECT CAST(n AS BIGINT) AS characters, CAST(length(s) AS BIGINT) AS bases, md5(s) AS digest FROM w""",
}
_AUDIT = " SELECT least(q_id, t_id) AS first_id" + _PAF_SQL["paf_pair_audit"].split(" SELECT least(q_id, t_id) AS first_id", 1)[1]
SQL["missing_side_causes"] = SQL["missing_side_causes"].replace("AUDIT", _AUDIT)
