"""Queries of problem 2: per-node results over edges whose rows sit on a few nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, join_states, two_step_walks
from ..session import table

_ENDS = ["source", "target", "weight"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "edges").select(*_ENDS), "source", "target", 25, 1000, "source", "target")


def p2_node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its rows as source and target, their weights, and the paths of two edges through it."""
    e = table(spark, sf_dir, "edges").select(*_ENDS)
    j = join_states(e, e, "source", "target", "weight", "weight")
    return j.select(
        F.col("key").alias("node"), F.col("left_n").alias("n_out"), F.col("left_sum").alias("weight_out"),
        F.col("right_n").alias("n_in"), F.col("right_sum").alias("weight_in"), F.col("joined_n").alias("paths"), F.col("joined_sum").alias("path_weight"),
    )


def p2_two_step_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_step_walks(table(spark, sf_dir, "edges").select(*_ENDS))


QUERIES = {"p2_found": p2_found, "p2_node_states": p2_node_states, "p2_two_step_walks": p2_two_step_walks}

SQL = {
    "p2_found": """
        WITH t AS (SELECT count(*) AS n FROM edges),
        s AS (SELECT 'source' AS side, source AS node, count(*) AS n FROM edges WHERE source <> '' GROUP BY source
              UNION ALL SELECT 'target', target, count(*) FROM edges WHERE target <> '' GROUP BY target)
        SELECT side, node FROM s, t WHERE s.n * 40 >= t.n""",
    "p2_node_states": """
        WITH o AS (SELECT source AS node, count(*) AS n, coalesce(sum(weight), 0) AS w FROM edges WHERE source <> '' GROUP BY source),
        i AS (SELECT target AS node, count(*) AS n, coalesce(sum(weight), 0) AS w FROM edges WHERE target <> '' GROUP BY target),
        j AS (SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS n_out, coalesce(o.w, 0) AS w_out,
                     coalesce(i.n, 0) AS n_in, coalesce(i.w, 0) AS w_in FROM o FULL OUTER JOIN i ON o.node = i.node)
        SELECT node, CAST(n_out AS BIGINT) AS n_out, CAST(w_out AS BIGINT) AS weight_out, CAST(n_in AS BIGINT) AS n_in,
               CAST(w_in AS BIGINT) AS weight_in, CAST(n_out * n_in AS BIGINT) AS paths,
               CAST(w_out * n_in + w_in * n_out AS BIGINT) AS path_weight FROM j""",
    "p2_two_step_walks": """
        WITH e AS (SELECT source, target, coalesce(weight, 0) AS w FROM edges WHERE source <> '' AND target <> ''),
        a AS (SELECT source, target, count(*) AS n, sum(w) AS w FROM e GROUP BY source, target),
        b AS (SELECT source AS target, count(*) AS n, sum(w) AS w FROM e GROUP BY source)
        SELECT a.source AS node, CAST(sum(a.n * b.n) AS BIGINT) AS walks, CAST(sum(a.w * b.n + b.w * a.n) AS BIGINT) AS walk_weight
        FROM a JOIN b ON a.target = b.target GROUP BY a.source""",
}
