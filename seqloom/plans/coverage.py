"""Queries of problem 4: covered stretches of contigs and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps, unwrap_circular
from ..session import table


def _intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    d = df.select(F.col("contig").alias("entity"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
    return d.where(F.col("entity").isNotNull() & (F.col("start") >= 0) & (F.col("start") < F.col("end")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = table(spark, sf_dir, "contigs").where("topology = 'circular'").select(F.col("contig").alias("entity"), F.col("length").cast("bigint").alias("length"))
    nodes = _intervals(table(spark, sf_dir, "nodes"), "start", "end")
    placed = unwrap_circular(_intervals(table(spark, sf_dir, "placements"), "reference_start", "reference_end"), circles)
    entity = lambda layer: F.struct(F.lit(layer).alias("layer"), F.col("entity").alias("contig")).alias("entity")
    both = nodes.select(entity("nodes"), "start", "end").unionByName(placed.select(entity("placements"), "start", "end"))
    return periods_and_gaps(both).select("entity.layer", "entity.contig", "kind", "pos_start", "pos_end")


def p4_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per layer and contig: periods, gaps, positions covered and positions in gaps."""
    f = p4_found(spark, sf_dir)
    size = F.col("pos_end") - F.col("pos_start")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    s = lambda kind: F.sum(F.when(F.col("kind") == kind, size).otherwise(F.lit(0).cast("bigint")))
    return f.groupBy("layer", "contig").agg(n("covered").alias("periods"), n("gap").alias("gaps"), s("covered").alias("covered"), s("gap").alias("uncovered"))


QUERIES = {"p4_found": p4_found, "p4_coverage_report": p4_coverage_report}

_FOUND = """
    WITH c AS (SELECT contig, length FROM contigs WHERE topology = 'circular' AND length > 0),
    p AS (SELECT p.contig, reference_start AS s, reference_end AS e, c.length AS n FROM placements p LEFT JOIN c ON p.contig = c.contig
          WHERE p.contig IS NOT NULL AND reference_start >= 0 AND reference_start < reference_end),
    q AS (SELECT contig, n, CASE WHEN n IS NULL THEN s WHEN e - s >= n THEN 0 ELSE s % n END AS s,
                 CASE WHEN n IS NULL THEN e WHEN e - s >= n THEN n ELSE s % n + e - s END AS e FROM p),
    i AS (SELECT 'nodes' AS layer, contig, start AS s, "end" AS e FROM nodes WHERE contig IS NOT NULL AND start >= 0 AND start < "end"
          UNION ALL SELECT 'placements', contig, s, CASE WHEN e > n THEN n ELSE e END FROM q
          UNION ALL SELECT 'placements', contig, 0, e - n FROM q WHERE e > n),
    m AS (SELECT layer, contig, s, e, max(e) OVER (PARTITION BY layer, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT layer, contig, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY layer, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
    d AS (SELECT layer, contig, g, min(s) AS s, max(e) AS e FROM g GROUP BY layer, contig, g),
    f AS (SELECT layer, contig, s, e, lead(s) OVER (PARTITION BY layer, contig ORDER BY s) AS nxt FROM d),
    found AS (SELECT layer, contig, 'covered' AS kind, CAST(s AS BIGINT) AS pos_start, CAST(e AS BIGINT) AS pos_end FROM f
          UNION ALL SELECT layer, contig, 'gap', CAST(e AS BIGINT), CAST(nxt AS BIGINT) FROM f WHERE nxt IS NOT NULL)"""

SQL = {
    "p4_found": _FOUND + " SELECT layer, contig, kind, pos_start, pos_end FROM found",
    "p4_coverage_report": _FOUND + """
        SELECT layer, contig, count(*) FILTER (kind = 'covered') AS periods, count(*) FILTER (kind = 'gap') AS gaps,
               CAST(coalesce(sum(pos_end - pos_start) FILTER (kind = 'covered'), 0) AS BIGINT) AS covered,
               CAST(coalesce(sum(pos_end - pos_start) FILTER (kind = 'gap'), 0) AS BIGINT) AS uncovered
        FROM found GROUP BY layer, contig""",
}
