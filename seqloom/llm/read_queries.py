"""Queries of problems 1 (near-duplicate reads) and 3 (sequence shared verbatim)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, new_path, table
from .near_duplicates import class_report, expand_pairs, near_duplicates
from .shared_spans import SpanStore, shared_spans


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reads").select("rid", "seq")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates(_reads(spark, sf_dir), "rid", "seq")
    return expand_pairs(links, members).select(F.col("id_a").alias("rid_a"), F.col("id_b").alias("rid_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates(_reads(spark, sf_dir), "rid", "seq")
    return class_report(links, members).select(F.col("id").alias("rid"), "class_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_reads(spark, sf_dir), "rid", "seq").select(F.col("id").alias("rid"), "span_start", "span_end")


def p3_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, from a store that is opened anew for each of two batches of reads."""
    reads, path = _reads(spark, sf_dir), new_path(spark, "store")
    for b in range(2):
        with SpanStore(spark, path) as store:
            store.add(reads.where(F.pmod(F.xxhash64("rid"), F.lit(2)) == b), "rid", "seq")
            found = store.spans() if b else None
    drop(spark, path)
    return found.select(F.col("id").alias("rid"), "span_start", "span_end")


def p3_shared_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: its length, the positions shared with other reads, and their share."""
    spans = p3_found(spark, sf_dir).groupBy("rid").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    reads = _reads(spark, sf_dir).groupBy("rid").agg(F.max(F.length("seq").cast("bigint")).alias("length"))
    shared = F.coalesce("shared", F.lit(0).cast("bigint"))
    return reads.join(spans, "rid", "left").select("rid", "length", shared.alias("shared"), F.when(F.col("length") > 0, F.round(shared / F.col("length"), 6)).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p3_incremental": p3_incremental, "p3_shared_length": p3_shared_length}

_SETS = """
    WITH r AS (SELECT DISTINCT rid, upper(seq) AS seq FROM reads WHERE rid IS NOT NULL AND length(seq) >= 21),
    w AS (SELECT rid, substr(seq, k, 21) AS w FROM (SELECT rid, seq, unnest(range(1, length(seq) - 19)) AS k FROM r)),
    s AS (SELECT DISTINCT rid, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS w FROM w WHERE NOT regexp_matches(w, '[^ACGT]')),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    i AS (SELECT a.rid AS rid_a, b.rid AS rid_b, count(*) AS common FROM s a JOIN s b ON a.w = b.w AND a.rid < b.rid GROUP BY a.rid, b.rid),
    found AS (SELECT rid_a, rid_b, common, x.n AS na, y.n AS nb FROM i JOIN n x ON x.rid = rid_a JOIN n y ON y.rid = rid_b WHERE 2 * common >= x.n + y.n - common)"""

_SPANS = """
    WITH r AS (SELECT DISTINCT rid, upper(seq) AS seq FROM reads WHERE rid IS NOT NULL AND length(seq) >= 100),
    w AS (SELECT rid, k - 1 AS s, substr(seq, k, 100) AS w FROM (SELECT rid, seq, unnest(range(1, length(seq) - 98)) AS k FROM r)),
    v AS (SELECT * FROM w WHERE NOT regexp_matches(w, '[^ACGT]')),
    t AS (SELECT w FROM v GROUP BY w HAVING min(rid) <> max(rid)),
    p AS (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS q FROM v SEMI JOIN t USING (w)),
    g AS (SELECT rid, s, sum(CASE WHEN q IS NULL OR s > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM p),
    found AS (SELECT rid, CAST(min(s) AS BIGINT) AS span_start, CAST(max(s) + 100 AS BIGINT) AS span_end FROM g GROUP BY rid, g)"""

SQL = {
    "p1_found": _SETS + " SELECT rid_a, rid_b FROM found",
    "p1_classes": _SETS + """,
        e AS (SELECT rid_a AS rid, rid_b AS other FROM found WHERE common = na AND common = nb UNION ALL SELECT rid_b, rid_a FROM found WHERE common = na AND common = nb),
        c AS (SELECT n.rid, least(n.rid, coalesce(min(e.other), n.rid)) AS class_id FROM n LEFT JOIN e USING (rid) GROUP BY n.rid),
        l AS (SELECT x.class_id AS a, y.class_id AS b FROM found JOIN c x ON x.rid = rid_a JOIN c y ON y.rid = rid_b WHERE x.class_id <> y.class_id),
        m AS (SELECT a AS class_id, count(DISTINCT b) AS links FROM (SELECT a, b FROM l UNION SELECT b, a FROM l) GROUP BY a)
        SELECT c.rid, c.class_id, coalesce(links, 0) AS links FROM c LEFT JOIN m USING (class_id)""",
    "p3_found": _SPANS + " SELECT rid, span_start, span_end FROM found",
    "p3_incremental": _SPANS + " SELECT rid, span_start, span_end FROM found",
    "p3_shared_length": _SPANS + """,
        a AS (SELECT rid, max(length(seq)) AS length FROM reads GROUP BY rid),
        b AS (SELECT rid, CAST(sum(span_end - span_start) AS BIGINT) AS shared FROM found GROUP BY rid)
        SELECT a.rid, length, coalesce(shared, 0) AS shared, CASE WHEN length > 0 THEN round(coalesce(shared, 0) / length, 6) END AS share FROM a LEFT JOIN b USING (rid)""",
}
