"""Pairwise-alignment records: parsing, the filter chain, evidence, candidates and edges.

The filter chain is one CASE over each record, so every record has exactly one outcome; evidence is a branch over the
records that passed the steps before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import tag_map

_INTS = {1: "q_len", 2: "q_st", 3: "q_en", 6: "t_len", 7: "t_st", 8: "t_en", 9: "n_match", 10: "block", 11: "mapq"}


@dataclass(frozen=True)
class PafConfig:
    min_mapq: int = 0
    min_overlap: int = 100
    min_identity: float | None = None
    full_coverage_identity: float | None = None
    max_error_hint: float = 0.30
    tolerance: int = 10
    containment_tolerance: int = 2
    reverse_strand: bool = True
    reciprocal: bool = True


def parse_paf(lines: DataFrame) -> DataFrame:
    """Records of text lines (``line_no``, ``line``): blank lines are dropped, lines of fewer than 12 fields are kept with ``malformed`` true and null fields."""
    f = F.split("line", "\t")
    ok = F.size(f) >= 12
    d = lines.where(F.trim("line") != "").withColumns({"_f": f, "malformed": ~ok})
    at = lambda i: F.when(~F.col("malformed"), F.col("_f")[i])
    return d.select(
        "line_no", "malformed", at(0).alias("q_id"), at(4).alias("strand"), at(5).alias("t_id"),
        *[at(i).try_cast("bigint").alias(n) for i, n in _INTS.items()],
        F.when(~F.col("malformed"), tag_map(F.slice("_f", F.lit(13), F.greatest(F.size("_f") - 12, F.lit(0))))).alias("tags"),
    )


def _near(c: PafConfig, pos: str | Column, length: str | Column | None = None) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return (p if length is None else (F.col(length) if isinstance(length, str) else length) - p) <= c.tolerance


def with_outcomes(paf: DataFrame, c: PafConfig) -> DataFrame:
    """Adds ``outcome`` of the filter chain, ``full`` and ``contained`` (the record is evidence), oriented target interval and ``case`` (geometry)."""
    same = F.col("strand") == "+"
    ots = F.when(same, F.col("t_st")).otherwise(F.col("t_len") - F.col("t_en"))
    ote = F.when(same, F.col("t_en")).otherwise(F.col("t_len") - F.col("t_st"))
    d = paf.withColumns({"ot_st": ots, "ot_en": ote, "orientation": F.when(same, 1).otherwise(-1)})
    ratio = F.col("n_match") / F.col("block")
    hint = F.coalesce(F.col("tags")["dv"].try_cast("double"), F.col("tags")["de"].try_cast("double"), 1 - ratio)
    q_all = (F.col("q_st") == 0) & (F.col("q_en") == F.col("q_len"))
    t_all = (F.col("t_st") == 0) & (F.col("t_en") == F.col("t_len"))
    full = (q_all & (F.col("q_len") < F.col("t_len"))) | (t_all & (F.col("t_len") < F.col("q_len"))) | (q_all & t_all & (F.col("q_len") == F.col("t_len")))
    tol = c.containment_tolerance
    whole = lambda s, e, n: (F.col(s) <= tol) & (F.col(n) - F.col(e) <= tol)
    inner = lambda s, e, n: (F.col(s) > tol) & (F.col(n) - F.col(e) > tol)
    q_in = whole("q_st", "q_en", "q_len") & inner("t_st", "t_en", "t_len") & (F.col("q_len") < F.col("t_len"))
    t_in = whole("t_st", "t_en", "t_len") & inner("q_st", "q_en", "q_len") & (F.col("t_len") < F.col("q_len"))
    to_query = _near(c, "ot_en", "t_len") & _near(c, "q_st") & (F.col("ot_st") > F.col("q_st"))
    to_target = _near(c, "q_en", "q_len") & _near(c, "ot_st") & (F.col("q_st") > F.col("ot_st"))
    d = d.withColumn("case", F.when(to_query, "target_query").when(to_target, "query_target"))
    before_full = [
        (F.col("malformed"), "skipped_malformed"), (F.col("q_id") == F.col("t_id"), "skipped_self"), (F.col("mapq") < c.min_mapq, "skipped_mapq"),
        (F.col("block") < c.min_overlap, "skipped_min_overlap"), (F.col("block") <= 0, "skipped_empty_alignment"),
    ]
    before_contained = [*([(ratio < c.min_identity, "skipped_paf_identity")] if c.min_identity is not None else []), (hint > c.max_error_hint, "skipped_error_hint")]
    last = [*([] if c.reverse_strand else [(~same, "skipped_reverse_strand")]), (F.col("case").isNull(), "skipped_geometry")]
    outcome = None
    for cond, name in [*before_full, *before_contained, *last]:
        outcome = F.when(cond, name) if outcome is None else outcome.when(cond, name)
    d = d.withColumn("outcome", outcome.otherwise("accepted"))
    early = [n for _, n in before_full]
    threshold = c.full_coverage_identity if c.full_coverage_identity is not None else c.min_identity
    is_full = F.lit(False) if threshold is None else ~F.col("outcome").isin(early) & full & (ratio >= threshold)
    late = [*early, *[n for _, n in before_contained]]
    return d.withColumns({
        "full": F.coalesce(is_full, F.lit(False)),
        "contained": F.when(~F.col("outcome").isin(late) & q_in, "query").when(~F.col("outcome").isin(late) & t_in, "target"),
    })


OUTCOMES = (
    "skipped_malformed", "skipped_self", "skipped_mapq", "skipped_min_overlap", "skipped_empty_alignment", "skipped_paf_identity", "skipped_error_hint", "skipped_reverse_strand",
    "skipped_geometry", "accepted",
)


def outcome_counts(d: DataFrame, c: PafConfig) -> DataFrame:
    """Counter of outcomes, raw records, evidence kept and reciprocal candidates, in one pass: ``outcome``, ``n``; what doesn't occur is left out."""
    q = F.col("contained") == "query"
    pair = F.when(F.col("full"), F.struct(F.least("q_id", "t_id"), F.greatest("q_id", "t_id")))
    inside = F.when(F.col("contained").isNotNull(), F.struct(F.when(q, F.col("q_id")).otherwise(F.col("t_id")).alias("a"), F.when(q, F.col("t_id")).otherwise(F.col("q_id")).alias("b"), "orientation"))
    # the orientation of a pair is +1 for the query and that of the record for the target, so which of them is contained matters as well
    inside = F.when(F.col("contained").isNotNull(), F.struct(inside.alias("x"), F.when(F.col("orientation") == -1, F.col("contained")).alias("y")))
    g = d.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count(F.lit(1)).alias("raw_records"),
        F.count_distinct(pair).alias("full_coverage_evidence"), F.count_distinct(inside).alias("containment_evidence"),
    )
    names = [*OUTCOMES, "raw_records", "full_coverage_evidence", "containment_evidence"]
    entries = [F.struct(F.lit(n).alias("outcome"), F.col(n).alias("n")) for n in names]
    if c.reciprocal:
        entries.append(F.struct(F.lit("accepted_reverse_complement").alias("outcome"), F.col("accepted").alias("n")))
    return g.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("n > 0")


def full_coverage(d: DataFrame) -> DataFrame:
    """Evidence that one read covers another from end to end; of an unordered pair the first record counts."""
    pair = Window.partitionBy(F.least("q_id", "t_id"), F.greatest("q_id", "t_id")).orderBy("line_no")
    e = d.where("full").withColumn("_k", F.row_number().over(pair)).where("_k = 1")
    return e.select(
        F.col("q_id").alias("first_id"), F.col("t_id").alias("second_id"), F.lit(1).alias("first_orientation"), F.col("orientation").alias("second_orientation"),
        (F.col("block")).alias("alignment_length"), (F.col("n_match") / F.col("block")).alias("identity"), "mapq", "line_no",
    )


def containment(d: DataFrame) -> DataFrame:
    """Evidence that a read lies inside another; of equal ids and orientations the first record counts."""
    q = F.col("contained") == "query"
    e = d.where("contained is not null").select(
        F.when(q, F.col("q_id")).otherwise(F.col("t_id")).alias("contained_id"), F.when(q, F.col("t_id")).otherwise(F.col("q_id")).alias("container_id"),
        F.when(q, F.lit(1)).otherwise(F.col("orientation")).alias("contained_orientation"), F.when(q, F.col("orientation")).otherwise(F.lit(1)).alias("container_orientation"),
        F.col("block").alias("alignment_length"), (F.col("n_match") / F.col("block")).alias("identity"), "mapq", "line_no",
    )
    first = Window.partitionBy("contained_id", "container_id", "contained_orientation", "container_orientation").orderBy("line_no")
    return e.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def candidates(d: DataFrame) -> DataFrame:
    """Accepted records as directed candidates: the left read's end overlaps the right read's start."""
    t = F.col("case") == "target_query"
    pick = lambda a, b: F.when(t, a).otherwise(b)
    zero = F.lit(0).cast("bigint")
    return d.where("outcome = 'accepted'").select(
        pick(F.col("t_id"), F.col("q_id")).alias("left_id"), pick(F.col("q_id"), F.col("t_id")).alias("right_id"),
        F.col("q_id").alias("query_id"), F.col("t_id").alias("target_id"), "strand", "q_len", "q_st", "q_en", "t_len", "t_st", "t_en", "n_match", "block", "mapq",
        pick(F.greatest(zero, F.col("ot_st")), F.greatest(zero, F.col("q_st"))).alias("left_start_hint"), pick(F.col("t_len"), F.col("q_len")).alias("left_end_hint"),
        zero.alias("right_start_hint"), pick(F.least("q_len", "q_en"), F.least("t_len", "ot_en")).alias("right_end_hint"),
        F.col("block").alias("rough_overlap_len"), pick(F.col("ot_st") - F.col("q_st"), F.col("q_st") - F.col("ot_st")).alias("rough_shift"),
        pick(F.col("orientation"), F.lit(1)).alias("left_orientation"), pick(F.lit(1), F.col("orientation")).alias("right_orientation"), "line_no",
        pick(F.col("t_len"), F.col("q_len")).alias("left_len"), pick(F.col("q_len"), F.col("t_len")).alias("right_len"),
    )


def reciprocal(cand: DataFrame) -> DataFrame:
    """Each candidate as seen from the other strand: reads swapped, intervals mirrored, orientations turned."""
    c = F.col
    return cand.select(
        c("right_id").alias("left_id"), c("left_id").alias("right_id"), c("target_id").alias("query_id"), c("query_id").alias("target_id"), "strand",
        c("t_len").alias("q_len"), (c("t_len") - c("t_en")).alias("q_st"), (c("t_len") - c("t_st")).alias("q_en"),
        c("q_len").alias("t_len"), (c("q_len") - c("q_en")).alias("t_st"), (c("q_len") - c("q_st")).alias("t_en"), "n_match", "block", "mapq",
        F.greatest(F.lit(0), c("right_len") - c("right_end_hint")).alias("left_start_hint"), F.least("right_len", c("right_len") - c("right_start_hint")).alias("left_end_hint"),
        F.greatest(F.lit(0), c("left_len") - c("left_end_hint")).alias("right_start_hint"), F.least("left_len", c("left_len") - c("left_start_hint")).alias("right_end_hint"),
        "rough_overlap_len", (c("right_len") - c("right_end_hint") - c("left_len") + c("left_end_hint")).alias("rough_shift"),
        (-c("right_orientation")).alias("left_orientation"), (-c("left_orientation")).alias("right_orientation"), "line_no",
        c("right_len").alias("left_len"), c("left_len").alias("right_len"),
    )


def direct_edges(cand: DataFrame, source: str = "paf") -> DataFrame:
    """Candidates as edges without alignment: mismatches are the unmatched columns of the block."""
    miss = F.greatest(F.lit(0), F.col("block") - F.col("n_match"))
    pos = F.col("block") > 0
    return cand.select(
        "left_id", "right_id", F.col("left_start_hint").alias("left_start"), F.col("left_end_hint").alias("left_end"), F.col("right_start_hint").alias("right_start"),
        F.col("right_end_hint").alias("right_end"), F.col("block").alias("overlap_len"), F.col("rough_shift").alias("shift"), F.col("n_match").alias("matches"),
        miss.alias("mismatches"), F.lit(0).cast("bigint").alias("insertions"), F.lit(0).cast("bigint").alias("deletions"), miss.alias("edit_distance"),
        F.when(pos, miss / F.col("block")).otherwise(1.0).alias("error_rate"), F.when(pos, F.col("n_match") / F.col("block")).otherwise(0.0).alias("identity"),
        F.col("n_match").cast("double").alias("dp_score"), F.col("n_match").cast("double").alias("weight_dp"), F.lit(f"{source}_paf_direct").alias("candidate_source"),
        "mapq", pos.alias("accepted"), "left_orientation", "right_orientation", "line_no",
    )


def pair_audit(d: DataFrame, c: PafConfig) -> DataFrame:
    """Per unordered pair of reads: records, longest block, best identity, and the first step that none of its records passes."""
    e = d.where("not malformed and q_id <> t_id")
    ratio = F.when(F.col("block") > 0, F.col("n_match") / F.col("block")).otherwise(0.0)
    hint = F.coalesce(F.col("tags")["dv"].try_cast("double"), F.col("tags")["de"].try_cast("double"), 1 - ratio)
    e = e.select(F.least("q_id", "t_id").alias("first_id"), F.greatest("q_id", "t_id").alias("second_id"), "block", ratio.alias("ratio"), hint.alias("hint"), "case")
    stage = F.when(F.col("block") < c.min_overlap, 0).when(F.col("ratio") < (c.min_identity or 0.0), 1).when(F.col("hint") > c.max_error_hint, 2).when(F.col("case").isNull(), 3).otherwise(4)
    g = e.groupBy("first_id", "second_id").agg(F.count(F.lit(1)).alias("records"), F.max("block").alias("max_block"), F.max("ratio").alias("best_identity"), F.max(stage).alias("stage"))
    names = F.array(*[F.lit(x) for x in ("overlap", "identity", "error_hint", "geometry", "passes")])
    return g.select("first_id", "second_id", "records", "max_block", "best_identity", F.get(names, F.col("stage")).alias("status"))


def collinear_pairs(d: DataFrame, both: bool) -> DataFrame:
    """Best record by identity, then block, of each pair whose reads are both full (``both``) or whose shorter read is full (equal ones: both)."""
    q = (F.col("q_st") == 0) & (F.col("q_en") == F.col("q_len"))
    t = (F.col("t_st") == 0) & (F.col("t_en") == F.col("t_len"))
    cond = q & t if both else F.when(F.col("q_len") < F.col("t_len"), q).when(F.col("t_len") < F.col("q_len"), t).otherwise(q & t)
    e = d.where("not malformed and q_id <> t_id and block > 0").where(cond).withColumn("identity", F.col("n_match") / F.col("block"))
    return e.groupBy(F.least("q_id", "t_id").alias("first_id"), F.greatest("q_id", "t_id").alias("second_id")).agg(
        F.max(F.struct("identity", "block")).alias("best")
    ).select("first_id", "second_id", "best.identity", "best.block")


def exact_dovetails(d: DataFrame, cigar: str = "cigar") -> DataFrame:
    """Strict outward overlaps and containments of records with an exact CIGAR string (``=`` and ``X``, no ``M``, which fails the query).

    ``kind`` (``edge`` or ``contained``), ``source`` and ``target`` (signed reads of edges, plain ids of contained read and container), ``identity`` (equal columns over all), ``columns``,
    ``line_no``. Ends may differ by :func:`seqloom.functions.seq.dovetail_tolerance`; a record can give several rows.
    """
    from ..functions.seq import cigar_lengths, dovetail_tolerance

    equal, columns = cigar_lengths(cigar, "="), cigar_lengths(cigar, "=XID")
    plus = F.col("strand") == "+"
    e = d.where("q_id <> t_id").select(
        "line_no", "q_id", "t_id", F.concat("q_id", F.lit("+")).alias("u"), F.concat("t_id", "strand").alias("v"), "q_st",
        F.when(plus, F.col("t_st")).otherwise(F.col("t_len") - F.col("t_en")).alias("t0"), F.when(plus, F.col("t_len") - F.col("t_en")).otherwise(F.col("t_st")).alias("t1"),
        (F.col("q_len") - F.col("q_en")).alias("q1"), dovetail_tolerance(F.col("q_en") - F.col("q_st"), F.col("t_en") - F.col("t_st")).alias("tol"),
        F.when(F.contains(F.col(cigar), F.lit("M")), F.raise_error(F.lit("an exact CIGAR string is required"))).otherwise(F.when(columns > 0, equal / columns)).alias("identity"), columns.alias("columns"),
    )
    q0, q1, t0, t1 = (F.col(c) <= F.col("tol") for c in ("q_st", "q1", "t0", "t1"))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
    found = F.array(
        F.when(q0 & q1, row("contained", "q_id", "t_id")), F.when(t0 & t1, row("contained", "t_id", "q_id")),
        F.when(q1 & t0 & ~q0 & ~t1, row("edge", "u", "v")), F.when(t1 & q0 & ~t0 & ~q1, row("edge", "v", "u")),
    )
    return e.select("line_no", F.explode(F.array_compact(found)).alias("x"), "identity", "columns").select("x.kind", "x.source", "x.target", "identity", "columns", "line_no")
