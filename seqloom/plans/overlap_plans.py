"""Queries over overlaps between reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap as O
from ..operators import paf as P
from . import inputs

MIN_OVERLAP = 60


def dup_classes(spark, sf_dir):
    return O.duplicate_classes(inputs.reads(spark, sf_dir)).select("class_id", F.length("seq").cast("bigint").alias("length"), "n")


def class_expansion(spark, sf_dir):
    return O.class_members(inputs.reads(spark, sf_dir))


def exact_overlap_all(spark, sf_dir):
    return O.exact_overlaps(inputs.reads(spark, sf_dir), MIN_OVERLAP)


def exact_overlap_best(spark, sf_dir):
    return O.best_outgoing(O.exact_overlaps(inputs.reads(spark, sf_dir), MIN_OVERLAP, allow_full_length=False))


def exact_overlap_reads(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    return O.expand_classes(O.exact_overlaps(r, MIN_OVERLAP), O.class_members(r))


def ungapped_best(spark, sf_dir):
    return O.ungapped_overlaps(inputs.reads(spark, sf_dir), 100, 0.97)


def ungapped_best_strands(spark, sf_dir):
    return O.ungapped_overlaps(inputs.reads(spark, sf_dir), 100, 0.97, strands=True)


def contained_substring(spark, sf_dir):
    return O.contained_sequences(inputs.reads(spark, sf_dir))


def seed_chain_records(spark, sf_dir):
    return O.seed_chains(inputs.reads(spark, sf_dir))


def seed_chain_candidates(spark, sf_dir):
    """The native finder through the same filter chain as alignment files."""
    c = P.PafConfig(min_overlap=100, max_error_hint=1.0, tolerance=25)
    paf = O.seed_chains(inputs.reads(spark, sf_dir)).withColumns({"malformed": F.lit(False), "tags": F.expr("cast(map() as map<string,string>)"), "line_no": F.xxhash64("q_id", "t_id", "strand")})
    return P.candidates(P.with_outcomes(paf, c)).select("left_id", "right_id", "left_orientation", "right_orientation", "rough_overlap_len", "rough_shift")


def seed_chain_recall(spark, sf_dir):
    """Pairs of reads that overlap exactly or without gaps in at least 100 bases, and whether the native finder has at least 0.9 of them."""
    r = inputs.reads(spark, sf_dir)
    exact = O.expand_classes(O.exact_overlaps(r, 100), O.class_members(r)).select(F.lit("exact").alias("kind"), "left_id", "right_id")
    ungapped = O.ungapped_overlaps(r, 100, 0.97, strands=True).select(F.lit("ungapped").alias("kind"), "left_id", "right_id")
    m = lambda x: O.class_members(r).select(F.col("rid").alias(f"{x}_id"), F.col("class_id").alias(f"c{x}"))
    pairs = exact.unionByName(ungapped).join(m("left"), "left_id").join(m("right"), "right_id")
    found = O.seed_chains(r).select("q_id", "t_id", F.lit(1).alias("found")).distinct()
    pairs = pairs.where("cleft <> cright").select("kind", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.least("cleft", "cright").alias("q_id"), F.greatest("cleft", "cright").alias("t_id")).distinct()
    g = pairs.join(found, ["q_id", "t_id"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.count("found").alias("found"))
    return g.select("kind", "pairs", (F.col("found") >= F.col("pairs") * 0.9).alias("reached"))


QUERIES = {f.__name__: f for f in (dup_classes, class_expansion, exact_overlap_all, exact_overlap_best, exact_overlap_reads, ungapped_best, ungapped_best_strands, contained_substring, seed_chain_records, seed_chain_candidates, seed_chain_recall)}

_CLASSES = "WITH " + inputs.READS + ", c AS (SELECT min(rid) AS class_id, seq, count(*) AS n FROM r GROUP BY seq)"
_EXACT = _CLASSES + f""",
    s AS (SELECT class_id AS src, seq, unnest(range(1, length(seq) - {MIN_OVERLAP} + 2)) AS p FROM c WHERE length(seq) >= {MIN_OVERLAP}),
    h AS (SELECT src, class_id AS dst, length(s.seq) - p + 1 AS overlap, p FROM s JOIN c ON substr(s.seq, p, {MIN_OVERLAP}) = substr(c.seq, 1, {MIN_OVERLAP})
          WHERE src <> class_id AND length(s.seq) - p + 1 <= length(c.seq) AND substr(s.seq, p) = substr(c.seq, 1, length(s.seq) - p + 1) {{0}}),
    o AS (SELECT src, dst, CAST(max(overlap) AS BIGINT) AS overlap FROM h GROUP BY src, dst)"""
_UNGAPPED = "WITH " + inputs.READS + """,
    t AS ({0}),
    ka AS (SELECT rid, i, substr(seq, i, 13) AS k FROM (SELECT rid, seq, unnest(range(1, length(seq) - 11)) AS i FROM r)),
    kb AS (SELECT rid, o, j, substr(seq, j, 13) AS k FROM (SELECT rid, o, seq, unnest(range(1, length(seq) - 11)) AS j FROM t)),
    d AS (SELECT DISTINCT ka.rid AS a, kb.rid AS b, o, i - j AS shift FROM ka JOIN kb ON ka.k = kb.k AND ka.rid <> kb.rid AND i >= j WHERE NOT regexp_matches(ka.k, '[^ACGT]')),
    x AS (SELECT a, b, d.o, substr(r.seq, shift + 1) AS x, substr(t.seq, 1, length(r.seq) - shift) AS y FROM d JOIN r ON r.rid = a JOIN t ON t.rid = b AND t.o = d.o
          WHERE length(r.seq) - shift >= 100 AND length(r.seq) - shift <= length(t.seq)),
    m AS (SELECT a, b, o, length(x) AS n, hamming(x, y) AS miss FROM x),
    w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY (n - miss) / n DESC, n DESC, o DESC) AS k FROM m WHERE n - miss >= 0.97 * n - 1e-9)
    SELECT a AS left_id, b AS right_id, CAST(o AS INT) AS orientation, CAST(n AS BIGINT) AS overlap, CAST(n - miss AS BIGINT) AS matches FROM w WHERE k = 1"""

SQL = {
    "dup_classes": _CLASSES + " SELECT class_id, CAST(length(seq) AS BIGINT) AS length, n FROM c",
    "class_expansion": _CLASSES + " SELECT rid, class_id FROM r JOIN c USING (seq)",
    "exact_overlap_all": _EXACT.replace("{0}", "") + " SELECT * FROM o",
    "exact_overlap_best": _EXACT.replace("{0}", "AND p > 1 AND length(s.seq) - p + 1 < length(c.seq)") + " SELECT src, dst, overlap FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY overlap DESC, dst) AS k FROM o) WHERE k = 1",
    "exact_overlap_reads": _EXACT.replace("{0}", "") + " SELECT a.rid AS left_id, b.rid AS right_id, overlap FROM o JOIN c x ON x.class_id = src JOIN r a ON a.seq = x.seq JOIN c y ON y.class_id = dst JOIN r b ON b.seq = y.seq",
    "ungapped_best": _UNGAPPED.replace("{0}", "SELECT rid, 1 AS o, seq FROM r"),
    "ungapped_best_strands": _UNGAPPED.replace("{0}", "SELECT rid, 1 AS o, seq FROM r UNION ALL SELECT rid, -1, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM r"),
    "contained_substring": "WITH " + inputs.READS + """,
        w AS (SELECT rid, seq, unnest(range(1, length(seq) - 29)) AS p FROM r WHERE length(seq) >= 31),
        h AS (SELECT DISTINCT a.rid, w.rid AS container_id, length(w.seq) AS n FROM r a JOIN w ON substr(a.seq, 1, 31) = substr(w.seq, p, 31) AND length(a.seq) >= 31
              WHERE length(w.seq) > length(a.seq) AND substr(w.seq, p, length(a.seq)) = a.seq)
        SELECT rid, container_id FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, container_id) AS k FROM h) WHERE k = 1""",
}
_PAIRS = "SELECT '{0}' AS kind, count(DISTINCT (least(a, b), greatest(a, b))) AS pairs, true AS reached FROM ({1}) v JOIN r x ON x.rid = a JOIN r y ON y.rid = b WHERE x.seq <> y.seq"
SQL["seed_chain_recall"] = (
    _EXACT.replace("{0}", "").replace(str(MIN_OVERLAP), "100") + ", " + _UNGAPPED.split("WITH ", 1)[1].split(",", 1)[1].split(" FROM all_reads WHERE rid IS NOT NULL AND seq <> '' GROUP BY rid),", 1)[1].replace("{0}", "SELECT rid, 1 AS o, seq FROM r UNION ALL SELECT rid, -1, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM r").rsplit("SELECT a AS left_id", 1)[0]
    + _PAIRS.replace("{0}", "exact").replace("{1}", "SELECT a.rid AS a, b.rid AS b FROM o JOIN c x ON x.class_id = src JOIN r a ON a.seq = x.seq JOIN c y ON y.class_id = dst JOIN r b ON b.seq = y.seq")
    + " UNION ALL " + _PAIRS.replace("{0}", "ungapped").replace("{1}", "SELECT a, b FROM w WHERE k = 1")
)
SQL["exact_overlap_all"] = SQL["exact_overlap_all"].replace("{}", "")
