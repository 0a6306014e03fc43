"""Cleaned inputs of the queries, as DataFrames and as SQL over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import orientation_of, unsigned
from ..session import materialize, table

_ONCE: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table made from the stored ones, written at its first use in an application and read by every query after."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = materialize(make(), name)[0]
    return _ONCE[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read id of the reads and control reads, in upper case; empty ones are left out."""
    both = table(spark, sf_dir, "reads").drop("loaded_at").unionByName(table(spark, sf_dir, "control_reads").drop("loaded_at"))
    return (
        both.where("rid is not null and seq <> ''")
        .groupBy("rid")
        .agg(F.max(F.upper("seq")).alias("seq"), F.max("true_start").alias("true_start"), F.max("true_end").alias("true_end"), F.max("strand").alias("strand"))
    )


READS = """
    all_reads AS (SELECT rid, seq, true_start, true_end, strand FROM reads UNION ALL SELECT rid, seq, true_start, true_end, strand FROM control_reads),
    r AS (SELECT rid, max(upper(seq)) AS seq, max(true_start) AS true_start, max(true_end) AS true_end, max(strand) AS strand
          FROM all_reads WHERE rid IS NOT NULL AND seq <> '' GROUP BY rid)"""

_EDGE_COLUMNS = ["source", "target", "weight", "raw_quality_margin", "weight_divisor", "matching_bases", "errors", "identity", "alignment_block", "overlap_span", "paf_line"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap edges: repeated rows once, both ends present and signed, no read against itself; nulls in numbers are 0."""
    e = table(spark, sf_dir, "edges").select(*_EDGE_COLUMNS).where(r"source rlike '.[+-]$' and target rlike '.[+-]$'").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    e = e.select(
        unsigned("source").alias("left_id"), unsigned("target").alias("right_id"),
        orientation_of("source").alias("left_orientation"), orientation_of("target").alias("right_orientation"),
        "source", "target", zero("overlap_span").alias("overlap_len"), zero("matching_bases").alias("matches"), zero("errors").alias("mismatches"),
        F.lit(0).cast("bigint").alias("insertions"), F.lit(0).cast("bigint").alias("deletions"), zero("errors").alias("edit_distance"),
        zero("alignment_block").alias("block"), F.coalesce("identity", F.lit(0.0)).alias("identity"),
        F.when(zero("alignment_block") > 0, zero("errors") / F.col("alignment_block")).otherwise(1.0).alias("error_rate"),
        F.col("weight").cast("double").alias("weight_dp"), F.col("raw_quality_margin").cast("double").alias("dp_score"), "paf_line",
    )
    return e.where("left_id <> right_id")


EDGES = """
    raw_e AS (SELECT DISTINCT source, target, weight, raw_quality_margin, weight_divisor, matching_bases, errors, identity, alignment_block, overlap_span, paf_line FROM edges
              WHERE regexp_matches(source, '.[+-]$') AND regexp_matches(target, '.[+-]$')),
    e AS (SELECT source[:-2] AS left_id, target[:-2] AS right_id, CASE WHEN source[-1] = '+' THEN 1 ELSE -1 END AS left_orientation,
                 CASE WHEN target[-1] = '+' THEN 1 ELSE -1 END AS right_orientation, source, target, coalesce(overlap_span, 0) AS overlap_len,
                 coalesce(matching_bases, 0) AS matches, coalesce(errors, 0) AS mismatches, coalesce(alignment_block, 0) AS block, coalesce(identity, 0) AS identity,
                 CASE WHEN coalesce(alignment_block, 0) > 0 THEN coalesce(errors, 0) / alignment_block ELSE 1.0 END AS error_rate,
                 CAST(weight AS DOUBLE) AS weight_dp, CAST(raw_quality_margin AS DOUBLE) AS dp_score, paf_line
          FROM raw_e WHERE source[:-2] <> target[:-2])"""

_PAF = """
    SELECT left_id AS q_id, nq AS q_len,
           CASE WHEN k <= 2 THEN nq - span WHEN k <= 4 THEN 0 WHEN k <= 6 THEN 0 ELSE least(30, nq - 1) END AS q_st,
           CASE WHEN k <= 2 THEN nq WHEN k <= 4 THEN span WHEN k <= 6 THEN nq ELSE nq - 1 END AS q_en,
           CASE WHEN same = 1 THEN '+' ELSE '-' END AS strand, right_id AS t_id, nt AS t_len,
           CASE WHEN k <= 2 THEN (CASE WHEN same = 1 THEN 0 ELSE nt - span END) WHEN k <= 4 THEN (CASE WHEN same = 1 THEN nt - span ELSE 0 END)
                WHEN k = 5 THEN least(10, nt - 1) ELSE 0 END AS t_st,
           CASE WHEN k <= 2 THEN (CASE WHEN same = 1 THEN span ELSE nt END) WHEN k <= 4 THEN (CASE WHEN same = 1 THEN nt ELSE span END)
                WHEN k = 5 THEN least(10 + nq, nt) WHEN k = 6 THEN nt ELSE least(span, nt) END AS t_en,
           matches AS n_match, block, (paf_line * 7) % 61 AS mapq,
           CASE WHEN paf_line % 5 = 0 THEN 'dv:f:0.02' WHEN paf_line % 5 = 1 THEN 'de:f:0.3' WHEN paf_line % 5 = 2 THEN 'dv:f:x' ELSE 'tp:A:S' END AS tag,
           paf_line AS line_no
    FROM (SELECT e.left_id, e.right_id, e.matches, e.block, e.paf_line, e.paf_line % 8 AS k, e.left_orientation * e.right_orientation AS same,
                 CAST(length(a.seq) AS BIGINT) AS nq, CAST(length(b.seq) AS BIGINT) AS nt,
                 least(e.overlap_len, CAST(length(a.seq) AS BIGINT), CAST(length(b.seq) AS BIGINT)) AS span
          FROM e JOIN r a ON a.rid = e.left_id JOIN r b ON b.rid = e.right_id) AS x"""


def paf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all edges between stored reads, with coordinates that depend on the line number, so that every kind of geometry occurs."""
    text = _PAF.replace("FROM e JOIN r a", "FROM {e} AS e JOIN {r} AS a").replace("JOIN r b", "JOIN {r} AS b")
    return _once(spark, sf_dir, "alignments", lambda: spark.sql(text, e=edges(spark, sf_dir), r=reads(spark, sf_dir)))


def paf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text lines, some of them blank or short: ``line_no``, ``line``."""
    f = paf_fields(spark, sf_dir)
    line = F.concat_ws("\t", "q_id", "q_len", "q_st", "q_en", "strand", "t_id", "t_len", "t_st", "t_en", "n_match", "block", "mapq", "tag")
    lines = f.select("line_no", F.when(F.col("line_no") % 101 == 0, "  ").when(F.col("line_no") % 97 == 0, "short\tline").otherwise(line).alias("line"))
    return _once(spark, sf_dir, "alignment_lines", lambda: lines)


PAF = READS + "," + EDGES + ", paf AS (" + _PAF + ")"
