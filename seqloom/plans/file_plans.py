"""Queries that write the stored tables to files of every format and read them back, and streams over such files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paf as P
from ..operators import scoring as C
from ..session import new_path, table
from ..sources import files as R
from ..sources import sinks as W
from ..streaming import paf_stream as S
from . import inputs
from .paf_plans import CONFIG


_path = new_path


def fasta_roundtrip(spark, sf_dir):
    p = _path(spark, "fasta")
    W.write_lines(W.fasta_rows(inputs.reads(spark, sf_dir)), p)
    return R.read_fasta(spark, p)


def fastq_roundtrip(spark, sf_dir):
    p = _path(spark, "fastq")
    W.write_lines(W.fastq_rows(inputs.reads(spark, sf_dir)), p)
    return R.read_fastq(spark, p)


def paf_file_outcomes(spark, sf_dir):
    """Outcomes of the filter chain over an alignment file on disk."""
    p = _path(spark, "paf")
    W.write_lines(inputs.paf_lines(spark, sf_dir), p)
    d = P.with_outcomes(P.parse_paf(R.read_paf_lines(spark, p)), CONFIG)
    return d.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def paf_stream_outcomes(spark, sf_dir):
    """The same file as a stream."""
    p = _path(spark, "paf")
    W.write_lines(inputs.paf_lines(spark, sf_dir), p)
    out = _path(spark, "outcomes")
    S.outcome_sink(S.paf_stream(spark, p, CONFIG), out)
    return spark.read.parquet(out).groupBy("outcome").agg(F.sum("n").alias("n"))


def paf_stream_best(spark, sf_dir):
    """Best matches of every oriented pair, kept as state of a stream."""
    p, out = _path(spark, "paf"), _path(spark, "best")
    W.write_lines(inputs.paf_lines(spark, sf_dir), p)
    S.state_sink(S.best_edge_stream(S.paf_stream(spark, p, CONFIG)), out)
    key = ["left_id", "right_id", "left_orientation", "right_orientation"]
    return spark.read.parquet(out).groupBy(*key).agg(F.max_by("matches", "epoch").alias("matches"))


def _gfa_edges(spark, sf_dir):
    e = inputs.edges(spark, sf_dir)
    return e.withColumn("shift", F.col("block") - F.col("overlap_len"))


def gfa_roundtrip(spark, sf_dir):
    p = _path(spark, "gfa")
    e = _gfa_edges(spark, sf_dir)
    W.write_lines(W.gfa_rows(inputs.reads(spark, sf_dir).select(F.col("rid").alias("node"), "seq"), e), p)
    links = R.read_gfa(spark, p)[1]
    t = lambda k: F.col("tags")[k]
    return links.select("source", "source_sign", "target", "target_sign", "overlap", t("SH").alias("sh"), t("NM").alias("nm"), t("ID").alias("id"))


def gfa_segments(spark, sf_dir):
    p = _path(spark, "gfa")
    W.write_lines(W.gfa_rows(inputs.reads(spark, sf_dir).select(F.col("rid").alias("node"), "seq"), _gfa_edges(spark, sf_dir).limit(0)), p)
    return R.read_gfa(spark, p)[0].select("segment", F.length("seq").cast("bigint").alias("length"))


def gfa_paf_join(spark, sf_dir):
    """Links joined with the alignment records of the same rows of other files; both are written in parallel, in one order through all files."""
    e = _gfa_edges(spark, sf_dir).orderBy("paf_line", "source", "target")
    pg, pp = _path(spark, "gfa"), _path(spark, "paf")
    both = e.select("left_id", "right_id", "left_orientation", "right_orientation", "overlap_len", "shift", "mismatches", "identity", "paf_line")
    link = both.select(F.concat_ws("\t", F.lit("L"), "left_id", F.when(F.col("left_orientation") == 1, "+").otherwise("-"), "right_id", F.when(F.col("right_orientation") == 1, "+").otherwise("-"), F.concat(F.col("overlap_len"), F.lit("M"))).alias("line"))
    rec = both.select(F.concat_ws("\t", "left_id", F.lit(100), F.lit(0), F.lit(50), F.when(F.col("left_orientation") == F.col("right_orientation"), "+").otherwise("-"), "right_id", F.lit(100), F.lit(0), F.lit(50), F.lit(49), F.lit(50), F.lit(60)).alias("line"))
    W.write_lines(link, pg)
    W.write_lines(rec, pp)
    j = R.join_gfa_paf(R.read_gfa(spark, pg)[1], P.parse_paf(R.read_paf_lines(spark, pp)))
    return j.groupBy("source", "strand").agg(F.count(F.lit(1)).alias("links"))


def graph_tsv_roundtrip(spark, sf_dir):
    """Edges whose weight follows from matches and errors, through tab-separated files."""
    cols = [c.split()[0] for c in R.EDGES_TSV.split(", ")]
    e = table(spark, sf_dir, "edges").where("weight = matching_bases - 49 * errors and source <> '' and target <> ''").groupBy("source", "target").agg(F.min(F.struct("paf_line", *[c for c in cols if c not in ("source", "target", "paf_line")])).alias("b")).select("source", "target", "b.*")
    p = _path(spark, "edges")
    e.select(*cols).write.csv(p, sep="\t", header=True)
    n = table(spark, sf_dir, "nodes").select(*[c.split()[0] for c in R.NODES_TSV.split(", ")])
    pn = _path(spark, "nodes")
    n.write.csv(pn, sep="\t", header=True)
    nodes, edges = R.read_graph(spark, pn, p)
    return edges.select("source", "target", "weight", "identity", "paf_line")


def _rewarded(spark, sf_dir):
    e = inputs.edges(spark, sf_dir)
    return e.groupBy("left_id", "right_id").agg(F.max("overlap_len").cast("double").alias("reward"))


def dot_graph(spark, sf_dir):
    return W.dot_rows(_rewarded(spark, sf_dir)).where("ord = 2").select("line")


def dot_graph_oriented(spark, sf_dir):
    e = C.best_edges(inputs.edges(spark, sf_dir), "paf_line").withColumn("reward", F.col("overlap_len").cast("double"))
    return W.dot_rows(e, oriented=True, max_edges=200, highlight=e.where("identity >= 0.999")).select("line")


def paf_export(spark, sf_dir):
    n = lambda s: inputs.reads(spark, sf_dir).select(F.col("rid").alias(f"{s}_id"), F.length("seq").cast("bigint").alias(f"{s}_len"))
    e = _gfa_edges(spark, sf_dir).join(n("left"), "left_id").join(n("right"), "right_id")
    zero = F.lit(0).cast("bigint")
    e = e.withColumns({"left_start": F.greatest(zero, F.col("left_len") - F.col("overlap_len")), "left_end": F.col("left_len"), "right_start": zero, "right_end": F.least("right_len", "overlap_len")})
    return W.paf_rows(e)


def graph_table_export(spark, sf_dir):
    return W.table_rows(inputs.edges(spark, sf_dir), ["source", "target", "overlap_len", "matches", "mismatches", "paf_line"])


def graphml_export(spark, sf_dir):
    return W.graphml_rows(inputs.edges(spark, sf_dir).groupBy("source", "target").agg(F.max("overlap_len").alias("overlap_len"))).select("line")


def report_export(spark, sf_dir):
    """A report written as comma-separated files and read back."""
    p = _path(spark, "report")
    W.write_report(table(spark, sf_dir, "contigs").groupBy("topology").agg(F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("bases")), p)
    return spark.read.csv(p, header=True, schema="topology string, contigs bigint, bases bigint")


def window_export(spark, sf_dir):
    """Window graphs written with one folder each and read back by partition."""
    from .graph_plans import window_graphs

    p = _path(spark, "windows")
    W.write_windows(window_graphs(spark, sf_dir), p)
    return spark.read.parquet(p).groupBy("entity", "window").agg(F.count(F.lit(1)).alias("edges"), F.count_if("core").alias("core"))


_FUNCTIONS = (
    fasta_roundtrip, fastq_roundtrip, paf_file_outcomes, paf_stream_outcomes, paf_stream_best, gfa_roundtrip, gfa_segments, gfa_paf_join, graph_tsv_roundtrip, dot_graph, dot_graph_oriented, paf_export, graph_table_export, graphml_export,
    report_export, window_export,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

from .paf_plans import _BASE, _NAMES  # noqa: E402

_RE = "WITH " + inputs.READS + "," + inputs.EDGES
_OUTCOMES = _BASE + f" SELECT outcome, count(*) AS n FROM (SELECT {_NAMES} WHEN 9 THEN 'skipped_geometry' ELSE 'accepted' END AS outcome FROM st) GROUP BY outcome"
SQL = {
    "fasta_roundtrip": "WITH " + inputs.READS + " SELECT rid, seq FROM r",
    "fastq_roundtrip": "WITH " + inputs.READS + " SELECT rid, seq, CAST(-1 AS BIGINT) AS true_start, CAST(-1 AS BIGINT) AS true_end, 1 AS strand, CAST(NULL AS BIGINT[]) AS ref_coords FROM r",
    "paf_file_outcomes": _OUTCOMES,
    "paf_stream_outcomes": _OUTCOMES,
    "paf_stream_best": _BASE + " SELECT left_id, right_id, left_orientation, right_orientation, max(n_match) AS matches FROM cand GROUP BY ALL",
    "gfa_roundtrip": _RE + " SELECT left_id AS source, source[-1] AS source_sign, right_id AS target, target[-1] AS target_sign, overlap_len || 'M' AS overlap, CAST(block - overlap_len AS VARCHAR) AS sh, CAST(mismatches AS VARCHAR) AS nm, printf('%.12f', CAST(identity AS DOUBLE)) AS id FROM e",
    "gfa_segments": "WITH " + inputs.READS + " SELECT rid AS segment, CAST(length(seq) AS BIGINT) AS length FROM r",
    "gfa_paf_join": "WITH " + inputs.EDGES + " SELECT left_id AS source, CASE WHEN left_orientation = right_orientation THEN '+' ELSE '-' END AS strand, count(*) AS links FROM e GROUP BY 1, 2",
    "graph_tsv_roundtrip": "SELECT source, target, weight, identity, paf_line FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY paf_line) AS k FROM edges WHERE weight = matching_bases - 49 * errors AND source <> '' AND target <> '') WHERE k = 1",
    "dot_graph": "WITH " + inputs.EDGES + """, w AS (SELECT left_id, right_id, CAST(max(overlap_len) AS DOUBLE) AS r FROM e GROUP BY ALL), m AS (SELECT max(r) AS m FROM w)
        SELECT '  "' || left_id || '" -> "' || right_id || '" [label="' || printf('%.3f', r) || '", penwidth=' || printf('%.3f', 1 + 4 * greatest(0, r / m)) || '];' AS line FROM w, m""",
    "graph_table_export": "WITH " + inputs.EDGES + " SELECT source || chr(9) || target || chr(9) || overlap_len || chr(9) || matches || chr(9) || mismatches || chr(9) || paf_line AS line FROM e",
    "paf_export": _RE + """, j AS (SELECT e.*, length(a.seq) AS nl, length(b.seq) AS nr FROM e JOIN r a ON a.rid = left_id JOIN r b ON b.rid = right_id), k AS (SELECT *, greatest(0, nl - overlap_len) AS ls, least(nr, overlap_len) AS re FROM j)
        SELECT concat_ws(chr(9), left_id, nl, CASE WHEN left_orientation = -1 THEN 0 ELSE ls END, CASE WHEN left_orientation = -1 THEN nl - ls ELSE nl END, CASE WHEN left_orientation = right_orientation THEN '+' ELSE '-' END, right_id, nr,
            CASE WHEN right_orientation = -1 THEN nr - re ELSE 0 END, CASE WHEN right_orientation = -1 THEN nr ELSE re END, matches, overlap_len, 255, 'lo:i:' || left_orientation, 'ro:i:' || right_orientation, 'sh:i:' || (block - overlap_len), 'de:f:' || printf('%.9f', CAST(error_rate AS DOUBLE))) AS line FROM k""",
    "graphml_export": "WITH " + inputs.EDGES + """, g AS (SELECT source, target, max(overlap_len) AS o FROM e GROUP BY ALL)
        SELECT '<edge source="' || source || '" target="' || target || '"><data key="o">' || o || '</data></edge>' AS line FROM g UNION ALL SELECT DISTINCT '<node id="' || n || '"/>' FROM (SELECT source AS n FROM g UNION SELECT target FROM g)
        UNION ALL SELECT '</graph>' || chr(10) || '</graphml>' UNION ALL SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<key id="o" for="edge" attr.name="overlap" attr.type="long"/>' || chr(10) || '<graph edgedefault="directed">'""",
    "report_export": "SELECT topology, count(*) AS contigs, CAST(sum(length) AS BIGINT) AS bases FROM contigs GROUP BY topology",
}

from .graph_plans import WINDOW_COUNTS  # noqa: E402

SQL["window_export"] = WINDOW_COUNTS
SQL["dot_graph_oriented"] = "WITH " + inputs.EDGES + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY coalesce(weight_dp, dp_score) DESC NULLS LAST, paf_line) AS k FROM e) WHERE k = 1),
    t AS (SELECT source, target, CAST(overlap_len AS DOUBLE) AS r, identity >= 0.999 AS red FROM b ORDER BY overlap_len DESC, source, target LIMIT 200), m AS (SELECT max(r) AS m FROM t)
    SELECT 'digraph overlaps {' || chr(10) || '  rankdir=LR;' AS line UNION ALL SELECT '}'
    UNION ALL SELECT DISTINCT '  "' || n || '" [shape=box, fillcolor=' || CASE WHEN n[-1] = '-' THEN 'lightblue' ELSE 'white' END || '];' FROM (SELECT source AS n FROM t UNION SELECT target FROM t)
    UNION ALL SELECT '  "' || source || '" -> "' || target || '" [label="' || printf('%.3f', r) || '", penwidth=' || printf('%.3f', CASE WHEN m > 0 THEN 1 + 4 * greatest(0, least(1, r / m)) ELSE 1 END) || CASE WHEN red THEN ', color=red' ELSE '' END || '];' FROM t, m"""
