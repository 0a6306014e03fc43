"""Queries over alignment records: parsing, filters, evidence, candidates, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paf as P
from . import inputs

CONFIG = P.PafConfig(min_mapq=2, min_overlap=60, min_identity=0.985, full_coverage_identity=0.99, max_error_hint=0.2, reverse_strand=True)
FORWARD = P.PafConfig(min_mapq=2, min_overlap=60, min_identity=0.985, full_coverage_identity=0.99, max_error_hint=0.2, reverse_strand=False, reciprocal=False)


def _records(spark: SparkSession, sf_dir: str, c: P.PafConfig = CONFIG) -> DataFrame:
    return P.with_outcomes(P.parse_paf(inputs.paf_lines(spark, sf_dir)), c)


def paf_parsed(spark, sf_dir):
    d = P.parse_paf(inputs.paf_lines(spark, sf_dir))
    return d.select("line_no", "malformed", "q_id", "q_len", "q_st", "q_en", "strand", "t_id", "t_len", "t_st", "t_en", "n_match", "block", "mapq", F.col("tags")["dv"].alias("dv"), F.col("tags")["de"].alias("de"))


def paf_outcomes(spark, sf_dir):
    return P.outcome_counts(_records(spark, sf_dir), CONFIG)


def paf_outcomes_forward(spark, sf_dir):
    return P.outcome_counts(_records(spark, sf_dir, FORWARD), FORWARD)


_CAND = ["left_id", "right_id", "left_start_hint", "left_end_hint", "right_start_hint", "right_end_hint", "rough_overlap_len", "rough_shift", "left_orientation", "right_orientation", "line_no"]


def paf_candidates(spark, sf_dir):
    return P.candidates(_records(spark, sf_dir)).select(*_CAND)


def paf_reciprocal(spark, sf_dir):
    return P.reciprocal(P.candidates(_records(spark, sf_dir))).select(*_CAND, "q_st", "q_en", "t_st", "t_en")


def paf_all_candidates(spark, sf_dir):
    c = P.candidates(_records(spark, sf_dir))
    return c.unionByName(P.reciprocal(c)).groupBy("left_orientation", "right_orientation").agg(F.count(F.lit(1)).alias("n"), F.sum("rough_shift").alias("shifts"))


def full_coverage_pairs(spark, sf_dir):
    return P.full_coverage(_records(spark, sf_dir))


def containment_evidence(spark, sf_dir):
    return P.containment(_records(spark, sf_dir))


def paf_direct_edges(spark, sf_dir):
    e = P.direct_edges(P.candidates(_records(spark, sf_dir)))
    return e.select("left_id", "right_id", "left_start", "left_end", "right_start", "right_end", "overlap_len", "shift", "matches", "mismatches", "error_rate", "identity", "dp_score", "candidate_source", "accepted", "line_no")


def paf_pair_audit(spark, sf_dir):
    return P.pair_audit(_records(spark, sf_dir), CONFIG)


def collinear_full_pairs(spark, sf_dir):
    return P.collinear_pairs(_records(spark, sf_dir), True)


def covered_pairs(spark, sf_dir):
    return P.collinear_pairs(_records(spark, sf_dir), False)


QUERIES = {
    f.__name__: f
    for f in (paf_parsed, paf_outcomes, paf_outcomes_forward, paf_candidates, paf_reciprocal, paf_all_candidates, full_coverage_pairs, containment_evidence, paf_direct_edges, paf_pair_audit, collinear_full_pairs, covered_pairs)
}

_BASE = "WITH " + inputs.PAF + """,
    rec AS (SELECT *, line_no % 97 = 0 AS bad, CASE WHEN strand = '+' THEN t_st ELSE t_len - t_en END AS os, CASE WHEN strand = '+' THEN t_en ELSE t_len - t_st END AS oe,
                   CASE WHEN strand = '+' THEN 1 ELSE -1 END AS o, n_match / block AS ratio,
                   CASE WHEN tag = 'dv:f:0.02' THEN 0.02 WHEN tag = 'de:f:0.3' THEN 0.3 ELSE 1 - n_match / block END AS hint
            FROM paf WHERE line_no % 101 <> 0),
    geo AS (SELECT *, CASE WHEN t_len - oe <= 10 AND q_st <= 10 AND os > q_st THEN 'tq' WHEN q_len - q_en <= 10 AND os <= 10 AND q_st > os THEN 'qt' END AS g,
                   (q_st = 0 AND q_en = q_len) AS qa, (t_st = 0 AND t_en = t_len) AS ta,
                   q_st <= 2 AND q_len - q_en <= 2 AND t_st > 2 AND t_len - t_en > 2 AND q_len < t_len AS qin,
                   t_st <= 2 AND t_len - t_en <= 2 AND q_st > 2 AND q_len - q_en > 2 AND t_len < q_len AS tin FROM rec),
    st AS (SELECT *, CASE WHEN bad THEN 1 WHEN mapq < 2 THEN 3 WHEN block < 60 THEN 4 WHEN ratio < 0.985 THEN 6 WHEN hint > 0.2 THEN 7 WHEN g IS NULL THEN 9 ELSE 10 END AS step,
                  (qa AND q_len < t_len) OR (ta AND t_len < q_len) OR (qa AND ta AND q_len = t_len) AS fc FROM geo),
    fcov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(q_id, t_id), greatest(q_id, t_id) ORDER BY line_no) AS k FROM st WHERE step > 4 AND fc AND ratio >= 0.99) WHERE k = 1),
    ev AS (SELECT CASE WHEN qin THEN q_id ELSE t_id END AS contained_id, CASE WHEN qin THEN t_id ELSE q_id END AS container_id, CAST(CASE WHEN qin THEN 1 ELSE o END AS INT) AS contained_orientation,
                  CAST(CASE WHEN qin THEN o ELSE 1 END AS INT) AS container_orientation, block AS alignment_length, ratio AS identity, mapq, line_no FROM st WHERE step > 7 AND (qin OR tin)),
    cont AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY contained_id, container_id, contained_orientation, container_orientation ORDER BY line_no) AS k FROM ev) WHERE k = 1),
    cand AS (SELECT CASE WHEN g = 'tq' THEN t_id ELSE q_id END AS left_id, CASE WHEN g = 'tq' THEN q_id ELSE t_id END AS right_id,
                    CASE WHEN g = 'tq' THEN greatest(0, os) ELSE greatest(0, q_st) END AS left_start_hint, CASE WHEN g = 'tq' THEN t_len ELSE q_len END AS left_end_hint,
                    CAST(0 AS BIGINT) AS right_start_hint, CASE WHEN g = 'tq' THEN least(q_len, q_en) ELSE least(t_len, oe) END AS right_end_hint, block AS rough_overlap_len,
                    CASE WHEN g = 'tq' THEN os - q_st ELSE q_st - os END AS rough_shift, CAST(CASE WHEN g = 'tq' THEN o ELSE 1 END AS INT) AS left_orientation,
                    CAST(CASE WHEN g = 'tq' THEN 1 ELSE o END AS INT) AS right_orientation, line_no, CASE WHEN g = 'tq' THEN t_len ELSE q_len END AS nl, CASE WHEN g = 'tq' THEN q_len ELSE t_len END AS nr,
                    t_len - t_en AS q_st, t_len - t_st AS q_en, q_len - q_en AS t_st, q_len - q_st AS t_en, n_match, block, ratio FROM st WHERE step = 10),
    recip AS (SELECT right_id AS left_id, left_id AS right_id, greatest(0, nr - right_end_hint) AS left_start_hint, least(nr, nr - right_start_hint) AS left_end_hint,
                     greatest(0, nl - left_end_hint) AS right_start_hint, least(nl, nl - left_start_hint) AS right_end_hint, rough_overlap_len,
                     (nr - right_end_hint) - (nl - left_end_hint) AS rough_shift, CAST(-right_orientation AS INT) AS left_orientation, CAST(-left_orientation AS INT) AS right_orientation, line_no, q_st, q_en, t_st, t_en FROM cand)"""

_COUNTS = """ SELECT outcome, n FROM (
    SELECT outcome, count(*) AS n FROM o GROUP BY outcome UNION ALL SELECT 'raw_records', count(*) FROM o
    UNION ALL SELECT 'full_coverage_evidence', count(*) FROM fcov UNION ALL SELECT 'containment_evidence', count(*) FROM cont"""
_NAMES = "CASE step WHEN 1 THEN 'skipped_malformed' WHEN 3 THEN 'skipped_mapq' WHEN 4 THEN 'skipped_min_overlap' WHEN 6 THEN 'skipped_paf_identity' WHEN 7 THEN 'skipped_error_hint'"
_CANDS = ", ".join(_CAND)

SQL = {
    "paf_parsed": "WITH " + inputs.PAF + """ SELECT line_no, FALSE AS malformed, q_id, q_len, q_st, q_en, strand, t_id, t_len, t_st, t_en, n_match, block, mapq,
        CASE WHEN tag LIKE 'dv%' THEN tag[6:] END AS dv, CASE WHEN tag LIKE 'de%' THEN tag[6:] END AS de FROM paf WHERE line_no % 101 <> 0 AND line_no % 97 <> 0
        UNION ALL SELECT line_no, TRUE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM paf WHERE line_no % 101 <> 0 AND line_no % 97 = 0""",
    "paf_outcomes": _BASE + f", o AS (SELECT {_NAMES} WHEN 9 THEN 'skipped_geometry' ELSE 'accepted' END AS outcome FROM st)" + _COUNTS
        + " UNION ALL SELECT 'accepted_reverse_complement', count(*) FROM o WHERE outcome = 'accepted') WHERE n > 0",
    "paf_outcomes_forward": _BASE + f", o AS (SELECT CASE WHEN step > 7 AND strand <> '+' THEN 'skipped_reverse_strand' ELSE {_NAMES} WHEN 9 THEN 'skipped_geometry' ELSE 'accepted' END END AS outcome FROM st)" + _COUNTS + ") WHERE n > 0",
    "paf_candidates": _BASE + f" SELECT {_CANDS} FROM cand",
    "paf_reciprocal": _BASE + f" SELECT {_CANDS}, q_st, q_en, t_st, t_en FROM recip",
    "paf_all_candidates": _BASE + f""" SELECT left_orientation, right_orientation, count(*) AS n, CAST(sum(rough_shift) AS BIGINT) AS shifts
        FROM (SELECT {_CANDS} FROM cand UNION ALL SELECT {_CANDS} FROM recip) GROUP BY ALL""",
    "full_coverage_pairs": _BASE + """ SELECT q_id AS first_id, t_id AS second_id, 1 AS first_orientation, CAST(o AS INT) AS second_orientation, block AS alignment_length, ratio AS identity, mapq, line_no FROM fcov""",
    "containment_evidence": _BASE + " SELECT * FROM cont",
    "paf_direct_edges": _BASE + """ SELECT left_id, right_id, left_start_hint AS left_start, left_end_hint AS left_end, right_start_hint AS right_start, right_end_hint AS right_end, block AS overlap_len,
        rough_shift AS shift, n_match AS matches, greatest(0, block - n_match) AS mismatches, greatest(0, block - n_match) / block AS error_rate, ratio AS identity, CAST(n_match AS DOUBLE) AS dp_score,
        'paf_paf_direct' AS candidate_source, TRUE AS accepted, line_no FROM cand""",
    "paf_pair_audit": _BASE + """ SELECT least(q_id, t_id) AS first_id, greatest(q_id, t_id) AS second_id, count(*) AS records, max(block) AS max_block, max(CASE WHEN block > 0 THEN ratio ELSE 0 END) AS best_identity,
        CASE WHEN NOT bool_or(block >= 60) THEN 'overlap' WHEN NOT bool_or(block >= 60 AND ratio >= 0.985) THEN 'identity' WHEN NOT bool_or(block >= 60 AND ratio >= 0.985 AND hint <= 0.2) THEN 'error_hint'
             WHEN NOT bool_or(block >= 60 AND ratio >= 0.985 AND hint <= 0.2 AND g IS NOT NULL) THEN 'geometry' ELSE 'passes' END AS status FROM st WHERE NOT bad GROUP BY 1, 2""",
    "collinear_full_pairs": _BASE + """ SELECT first_id, second_id, b.i AS identity, b.b AS block FROM (SELECT least(q_id, t_id) AS first_id, greatest(q_id, t_id) AS second_id, max({'i': ratio, 'b': block}) AS b FROM st WHERE NOT bad AND block > 0 AND qa AND ta GROUP BY 1, 2)""",
    "covered_pairs": _BASE + """ SELECT first_id, second_id, b.i AS identity, b.b AS block FROM (SELECT least(q_id, t_id) AS first_id, greatest(q_id, t_id) AS second_id, max({'i': ratio, 'b': block}) AS b FROM st
        WHERE NOT bad AND block > 0 AND CASE WHEN q_len < t_len THEN qa WHEN t_len < q_len THEN ta ELSE qa AND ta END GROUP BY 1, 2)""",
}
