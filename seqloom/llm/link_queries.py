"""Queries of problems 5 (groups of linked reads) and 6 (best edges of every node)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .components import connected_components, links_from
from .topn import top_n


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsigned = lambda c: F.regexp_replace(c, "[+-]$", "").alias(c)
    edges = table(spark, sf_dir, "edges").select(unsigned("source"), unsigned("target"))
    return links_from(edges, "source", "target").unionByName(links_from(table(spark, sf_dir, "containment"), "contained_id", "container_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_links(spark, sf_dir))


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("reads"))


_KEEP = ["source", "target", "weight", "raw_quality_margin", "weight_divisor", "matching_bases", "errors", "identity", "alignment_block", "overlap_span", "paf_line"]


def _best(spark: SparkSession, sf_dir: str, side: str, other: str, n: int) -> DataFrame:
    e = table(spark, sf_dir, "edges").select(*_KEEP).where((F.col("source") != "") & (F.col("target") != ""))
    return top_n(e, [side], "weight", [F.col("identity").desc_nulls_last(), F.col(other).asc(), F.col("paf_line").asc()], n)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "source", "target", 3).select("source", "target", "paf_line").distinct()


def p6_best_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best edges into every target, with their rank."""
    return _best(spark, sf_dir, "target", "source", 10).select("target", "source", "paf_line", "weight", F.col("rank").cast("bigint").alias("rank"))


QUERIES = {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes, "p6_found": p6_found, "p6_best_incoming": p6_best_incoming}

_GROUPS = """
    WITH RECURSIVE l AS (
        SELECT regexp_replace(source, '[+-]$', '') AS a, regexp_replace(target, '[+-]$', '') AS b FROM edges WHERE source <> '' AND target <> ''
        UNION SELECT contained_id, container_id FROM containment WHERE contained_id <> '' AND container_id <> ''),
    u AS (SELECT a, b FROM l WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM l WHERE a <> b AND a <> '' AND b <> ''),
    low(id, root) USING KEY (id) AS (
        SELECT a, least(a, min(b)) FROM u GROUP BY a
        UNION
        SELECT u.a, min(low.root) FROM low JOIN u ON u.b = low.id JOIN recurring.low AS cur ON cur.id = u.a WHERE low.root < cur.root GROUP BY u.a)"""

SQL = {
    "p5_found": _GROUPS + " SELECT root AS group_id, id AS read_id FROM low",
    "p5_group_sizes": _GROUPS + " SELECT root AS group_id, count(*) AS reads FROM low GROUP BY root",
    "p6_found": """
        WITH d AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM edges WHERE source <> '' AND target <> '' AND weight IS NOT NULL)
        SELECT DISTINCT source, target, paf_line FROM (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, identity DESC NULLS LAST, target, paf_line) AS r FROM d) WHERE r <= 3""",
    "p6_best_incoming": """
        WITH d AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM edges WHERE source <> '' AND target <> '' AND weight IS NOT NULL)
        SELECT target, source, paf_line, weight, r AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, identity DESC NULLS LAST, source, paf_line) AS r FROM d) WHERE r <= 10""",
}
